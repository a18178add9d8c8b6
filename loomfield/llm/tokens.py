"""Token ids of whole texts by a public tokenizer file, fast through a cache of words.

The tokenizer at hand normalises, splits a text into words by a pattern and encodes each word on its own, so
a text's ids are its words' ids one after the other. Words repeat, hence each is encoded once per worker.
Texts where byte classes cannot tell the words apart are encoded whole by the library instead.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops

MOST_WORDS = 1_000_000
#: Texts whose words the byte classes below tell apart: ASCII but for the apostrophe and "<", and Latin letters.
_PLAIN = "^[\\t\\n\\r\\x20-\\x26\\x28-\\x3b\\x3d-\\x7eÀ-ÖØ-öø-įĲ-ž]*$"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes texts to int64 arrays; ``special_as_text`` treats special tokens' strings as ordinary text.

    Plain texts are split on byte classes and their words looked up by 64-bit hash and compared by their bytes. Others (contractions,
    letters beyond Latin, text of special tokens) go whole to the library.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.bytes = np.zeros(1 << 20, np.uint8)
        self.byte_at = np.zeros(1 << 16, np.int64)
        self.n_bytes = np.zeros(1 << 16, np.int64)
        self.used = self.words = self.used_bytes = 0

    def _store(self, raw: list[bytes]) -> np.ndarray:
        """Numbers of words that are new here, each kept with its bytes and its ids."""
        ids = [e.ids for e in self.whole.encode_batch_fast([w.decode() for w in raw], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        n, end = self.words, self.words + len(raw)
        while end > len(self.at):
            self.at, self.size, self.byte_at, self.n_bytes = (np.concatenate((x, x)) for x in (self.at, self.size, self.byte_at, self.n_bytes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        while self.used_bytes + len(text) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, self.bytes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.bytes[self.used_bytes : self.used_bytes + len(text)] = text
        self.size[n:end], self.n_bytes[n:end] = sizes, lengths
        self.at[n:end] = self.used + np.cumsum(sizes) - sizes
        self.byte_at[n:end] = self.used_bytes + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.used_bytes += len(text)
        self.words = end
        return np.arange(n, end)

    def _add(self, keys: np.ndarray, raw: list[bytes]) -> None:
        where = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, where, keys), np.insert(self.number, where, self._store(raw))

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words by key; -1 for those not seen yet."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], -1)

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = textops.text_buffers(pc.utf8_lower(column))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[offsets] = True
        edge = np.flatnonzero(cut)
        word = kind[edge[:-1]] != _SPACE
        starts, ends = edge[:-1][word], edge[1:][word]
        keys, first, which = np.unique(textops.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = self._numbers(keys)
        new = np.flatnonzero(number < 0)
        word_at = lambda k: data[starts[k] : ends[k]].tobytes()
        if len(new):
            self._add(keys[new], [word_at(k) for k in first[new].tolist()])
            number = self._numbers(keys)
        which = number[which]
        # words of one key are told apart by their bytes
        length = ends - starts
        other = np.flatnonzero(~((self.n_bytes[which] == length) & textops.same_spans(data, starts, np.minimum(length, self.n_bytes[which]), self.bytes[: self.used_bytes], self.byte_at[which])))
        if len(other):
            which[other] = self._store([word_at(k) for k in other.tolist()])
        size = self.size[which]
        ids = self.flat[textops.ragged(self.at[which], size)].astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each begins; null texts have none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.words > MOST_WORDS:
            self.clear()
        odd = np.flatnonzero(~pc.fill_null(pc.match_substring_regex(column, _PLAIN), True).to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._plain(column)
        plain = np.ones(len(column), bool)
        plain[odd] = False
        ids, at = self._plain(pc.if_else(pa.array(plain), column, pa.scalar("", column.type)))
        whole = dict(zip(odd.tolist(), self.whole.encode_batch_fast(column.take(pa.array(odd)).to_pylist(), add_special_tokens=False)))
        parts = [np.array(whole[k].ids, np.int64) if k in whole else ids[at[k] : at[k + 1]] for k in range(len(column))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_HERE: dict[tuple[str, bool], WordTokenizer] = {}


def worker_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    key = (path, special_as_text)
    if key not in _HERE:
        _HERE[key] = WordTokenizer(path, special_as_text)
    return _HERE[key]


def text_blocks(column, most: int = 1 << 20):
    """(first row, slice) for runs of rows of about ``most`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi
