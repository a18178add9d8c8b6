"""Dense features of whole texts, computed in vectorised passes over blocks of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops as T

_LETTERS = T.byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER = T.byte_class(range(65, 91))
_DIGITS = T.byte_class(range(48, 58))
_PUNCT = T.byte_class([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_ENDS = T.byte_class(b".!?")
_SYMBOLS = T.byte_class(b"#$%&*@^~=+<>_\\")
_BYTE_CLASSES = {
    "upper": _UPPER, "digits": _DIGITS, "punct": _PUNCT, "stops": T.byte_class(b"."), "commas": T.byte_class(b","), "shouts": T.byte_class(b"!"),
    "bars": T.byte_class(b"|"), "symbols": _SYMBOLS, "lines": T.byte_class(b"\n"), "non_ascii": T.byte_class(range(128, 256)), "brackets": T.byte_class(b"()[]{}"), "slashes": T.byte_class(b"/:"),
}
_CLASS_MATRIX = np.array(list(_BYTE_CLASSES.values()), np.float64).T

QUALITY = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "entropy", *(f"{k}_rate" for k in _BYTE_CLASSES),
    "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "words_a_line", "capital_words", "symbol_tails", "lower_words", "sentence_length",
)


def _sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def _count_by(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each document are in ``mask``, without an array of numbers as long as the text."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(mask.view(np.uint8), at[some], dtype=np.int64)
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per document, and the count of the most frequent one."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.diff(np.concatenate((first, [len(key)])))
    own = (key[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, own, run)
    return np.bincount(own, minlength=n).astype(float), top


def quality_features(column) -> np.ndarray:
    """One row of QUALITY for each text; an empty or null text has zeros."""
    out = []
    for lo, hi, data, at in T.blocks(column):
        n = hi - lo
        size = np.diff(at)
        if n == 1:  # perhaps a very long text
            counts = sum(np.bincount(data[x : x + T.BLOCK_BYTES], minlength=256) for x in range(0, max(1, len(data)), T.BLOCK_BYTES))[None, :].astype(float)
        else:
            counts = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
        p = counts / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        rates = (counts @ _CLASS_MATRIX) / np.maximum(size, 1)[:, None]
        starts, ends = T.word_spans(data, at, T.NOT_SPACE)
        first = T.counts_by_doc(starts, at)
        words = np.diff(first)
        doc = np.repeat(np.arange(n), words)
        length = (ends - starts).astype(float)
        w = np.maximum(words, 1)
        mean = _sum_by(doc, length, n) / w
        sd = np.sqrt(np.maximum(_sum_by(doc, length**2, n) / w - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, doc, length)
        h = T.span_hashes(data, starts, ends)
        distinct, top = _distinct(doc, h, n)
        same = doc[1:] == doc[:-1]
        pairs = T.mix(h[:-1] * np.uint64(31) + h[1:])[same]
        n_pairs = np.bincount(doc[1:][same], minlength=n)
        distinct_pairs, _ = _distinct(doc[1:][same], pairs, n)
        line_starts, line_ends = T.word_spans(data, at, ~T.byte_class(b"\n"))
        line_doc = np.repeat(np.arange(n), np.diff(T.counts_by_doc(line_starts, at)))
        lines = np.bincount(line_doc, minlength=n)
        distinct_lines, _ = _distinct(line_doc, T.span_hashes(data, line_starts, line_ends), n)
        begin, last = (data[starts], data[ends - 1]) if len(starts) else (data[:0], data[:0])
        stops = counts[:, list(b".!?")].sum(1)
        out.append(
            np.column_stack(
                (
                    np.log1p(size), np.log1p(words), mean, sd, longest, entropy, rates,
                    distinct / np.sqrt(w), np.where(n_pairs, distinct_pairs / np.maximum(n_pairs, 1), 1), top / w, np.where(lines, distinct_lines / np.maximum(lines, 1), 1), words / np.maximum(lines, 1),
                    _sum_by(doc, _UPPER[begin], n) / w, _sum_by(doc, _SYMBOLS[last] | T.byte_class(b"!|")[last], n) / w, _sum_by(doc, T.byte_class(range(97, 123))[begin], n) / w, words / (1 + stops),
                )
            )
        )
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, len(QUALITY)), np.float32)


#: Second-person words by which abuse is aimed at a reader; fixed values.
SECOND_PERSON = ("you", "your", "youre", "u", "ur", "yourself", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "dein", "deine", "ihr", "usted", "ustedes", "tú", "ti", "vos")
#: Plain insults that seed the learned lexicon; fixed values.
SEED_LEXICON = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "filth", "vermin", "imbecile", "hate", "shut")

PREFIXES = (4, 5, 6)
TOXICITY = (
    "log_words", "hits", "density", "distinct_hits", "weight_sum", "weight_max", "seed_hits", *(f"prefix{k}_hits" for k in PREFIXES), *(f"prefix{k}_density" for k in PREFIXES),
    "near_second_person", "second_person_density", "capitals", "capital_words", "punct_rate", "shout_rate", "symbol_rate", "obfuscated_rate", "stretched_rate", "masked_hits",
)

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!|", b"oieastasil"):
    _LEET[_a] = _b


class Words:
    """Lower-cased words of a block, by 64-bit hash of the whole word and of its first bytes."""

    def __init__(self, column):
        lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        self.blocks = T.blocks(lowered, T.BLOCK_BYTES)

    def __iter__(self):
        for lo, hi, data, at in self.blocks:
            starts, ends = T.word_spans(data, at, T.ALNUM)
            yield lo, hi, data, at, starts, ends, T.counts_by_doc(starts, at)


def word_keys(data, starts, ends) -> np.ndarray:
    return T.span_hashes(data, starts, ends)


def prefix_keys(data, starts, ends, k: int) -> np.ndarray:
    """Hash of the first k bytes of words longer than that; 0 for the others."""
    return np.where(ends - starts > k, T.span_hashes(data, starts, np.minimum(starts + k, ends)), np.uint64(0))


def keys_of(words) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    n = np.cumsum([len(w.encode()) for w in words])
    return word_keys(data, np.concatenate(([0], n[:-1])), n)


class Lexicon:
    """Learned words and word beginnings with their weights, as sorted hashes."""

    def __init__(self, words: dict[int, float], prefixes: dict[int, dict[int, float]]):
        seeds = {int(k): 2.0 for k in keys_of(SEED_LEXICON)}
        self.words = self._table(seeds | words)
        self.seeds = np.sort(np.array(list(seeds), np.uint64))
        self.prefixes = {k: self._table(v) for k, v in prefixes.items()}
        self.you = np.sort(keys_of(SECOND_PERSON))

    @staticmethod
    def _table(weights: dict[int, float]):
        keys = np.array(list(weights), np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array(list(weights.values()), float)[order]

    @staticmethod
    def look(table, keys: np.ndarray) -> np.ndarray:
        known, weight = table
        if not len(known) or not len(keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, weight[at], 0.0)


def toxicity_features(column, lexicon: Lexicon) -> np.ndarray:
    """One row of TOXICITY for each text; an empty or null text has zeros."""
    out = []
    raw_blocks = T.blocks(pc.fill_null(column.cast(pa.large_string()), ""))
    for lo, hi, raw, raw_at in raw_blocks:
        part = column.slice(lo, hi - lo)
        data, at = T.text_buffers(pc.utf8_lower(pc.fill_null(part.cast(pa.large_string()), "")))
        data, at = data[at[0] : at[-1]], at - at[0]
        n = hi - lo
        starts, ends = T.word_spans(data, at, T.ALNUM)
        first = T.counts_by_doc(starts, at)
        words = np.diff(first)
        w = np.maximum(words, 1)
        doc = np.repeat(np.arange(n), words)
        keys = word_keys(data, starts, ends)
        weight = lexicon.look(lexicon.words, keys)
        hit = weight > 0
        hits = _sum_by(doc, hit, n)
        distinct, _ = _distinct(doc[hit], keys[hit], n)
        most = np.zeros(n)
        np.maximum.at(most, doc, weight)
        seeds = _sum_by(doc, lexicon.look((lexicon.seeds, np.ones(len(lexicon.seeds))), keys), n)
        prefix = [_sum_by(doc, lexicon.look(lexicon.prefixes[k], prefix_keys(data, starts, ends, k)) > 0, n) for k in PREFIXES]
        you = lexicon.look((lexicon.you, np.ones(len(lexicon.you))), keys) > 0
        near = np.zeros(len(you), bool)
        for k in range(1, 5):
            same = doc[k:] == doc[:-k] if len(doc) > k else np.zeros(0, bool)
            if len(same):
                near[k:] |= you[:-k] & same
                near[:-k] |= you[k:] & same
        # obfuscation: words of letters with digits or symbols inside, and insults spelled with them
        loose_starts, loose_ends = T.word_spans(data, at, T.NOT_SPACE)
        loose_first = T.counts_by_doc(loose_starts, at)
        loose_doc = np.repeat(np.arange(n), np.diff(loose_first))
        lw = np.maximum(np.diff(loose_first), 1)
        other = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(~_LETTERS[data] & (data > 32), out=other[1:], dtype=other.dtype)
        inner = other[np.maximum(loose_ends - 1, loose_starts)] - other[np.minimum(loose_starts + 1, loose_ends)]
        obscured = (inner > 0) & (loose_ends - loose_starts > 3)
        plain = _LEET[data]
        unmasked = lexicon.look(lexicon.words, T.span_hashes(plain, loose_starts[obscured], loose_ends[obscured])) > 0
        # a run of three bytes counts where it ends, as it may end just inside the next document
        stretched = np.zeros(len(data), bool)
        if len(data) > 2:
            stretched[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTERS[data[2:]]
        raw_n = np.maximum(np.diff(raw_at), 1)
        upper = _count_by(_UPPER[raw], raw_at) / raw_n
        caps_s, caps_e = T.word_spans(raw, raw_at, _UPPER)
        caps = _sum_by(np.searchsorted(raw_at, caps_s[caps_e - caps_s > 2], side="right") - 1, np.ones(int((caps_e - caps_s > 2).sum())), n)
        out.append(
            np.column_stack(
                (
                    np.log1p(words), hits, hits / w, distinct, _sum_by(doc, weight, n), most, seeds, *prefix, *(p / w for p in prefix),
                    _sum_by(doc, hit & near, n), _sum_by(doc, you, n) / w, upper, caps / w, _count_by(_PUNCT[raw], raw_at) / raw_n, _count_by(raw == 33, raw_at) / raw_n, _count_by(_SYMBOLS[raw], raw_at) / raw_n,
                    _sum_by(loose_doc, obscured, n) / lw, _count_by(stretched, at) / w, _sum_by(loose_doc[obscured], unmasked, n),
                )
            )
        )
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, len(TOXICITY)), np.float32)
