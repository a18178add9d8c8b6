"""Best-fit packing by patterns: few-document length patterns, repeat counts by non-negative least squares.

``plan_packing`` sees only the histogram of piece lengths, of at most ``capacity`` bins whatever the corpus.
It enumerates patterns of two to four lengths that fill a sequence, and draws more of any number of lengths where a
sequence holds many, fits how often to use each to the
histogram by non-negative least squares, rounds down, then up where pieces are left, and fits anew what is left while that
places pieces: first with full patterns, then, where the lengths left have none, with patterns of a growing gap. The rest is
packed best-fit over the histogram. ``partners`` and ``PATTERNS`` bound how many patterns one fit sees,
which decides how much is left to best fit, never whether a piece is packed.
``pack`` numbers the pieces in the order of their lengths over range partitions (a length may hold a third of all
pieces), and looks up the sequence and offset of each number in the plan.

A null or empty text is one piece of the single end token. Repeated rows are packed each on their own; ties
of length are broken by document and piece, then by hash. No rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfield.operators.relational import free_names, ordered_numbers

from .shared import materialize, table
from .tokens import default_tokenizer_path, text_blocks, worker_tokenizer

CAPACITY = 2048
END = 0
#: Patterns of any number of lengths that are drawn for one fit.
PATTERNS = 1500
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def tokenize_pieces(docs: DataFrame, *, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text plus the end id; ids as little-endian uint32."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, texts in text_blocks(batch.column(1)):
                ids, at = worker_tokenizer(path).encode(texts)
                n = np.diff(at) + 1
                flat = np.full(int(n.sum()), END, "<u4")
                begin = np.concatenate(([0], np.cumsum(n)))
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                where = begin[doc] + start
                raw = flat.tobytes()
                parts = [raw[4 * a : 4 * (a + b)] for a, b in zip(where.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(doc + lo)).cast(pa.int64()),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))),
                        pa.array(parts if keep_ids else [None] * len(parts), pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def nnls(index: np.ndarray, column: np.ndarray, value: np.ndarray, b: np.ndarray, n: int, rounds: int = 8, steps: int = 50) -> np.ndarray:
    """Non-negative least squares for a sparse non-negative matrix of ``value`` at (index, column): accelerated projected
    gradients, begun anew whenever a step turns back. A row weighs by the inverse of what it holds, a longer length a little
    more. Steps are taken in a diagonal metric that bounds the curvature about the point each round starts from, so that
    patterns used a million times and once are reached alike."""
    weigh = (0.25 + np.arange(len(b)) / len(b)) / np.maximum(b, 1.0)
    times = lambda v: np.bincount(index, value * v[column], len(b))
    turned = lambda r: np.bincount(column, value * r[index], n)
    x = np.full(n, np.inf)
    np.minimum.at(x, column, (b / np.maximum(np.bincount(index, value, len(b)), 1))[index] / value)
    for _ in range(rounds):
        x = np.maximum(x, 1e-6)
        metric = np.maximum(turned(weigh * times(x)), 1e-300) / x
        y, t = x, 1.0
        for _ in range(steps):
            gradient = turned(weigh * (times(y) - b))
            new = np.maximum(0.0, y - gradient / metric)
            if gradient @ (new - x) > 0:
                t = 1.0
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = np.maximum(new + (t - 1) / later * (new - x), 0.0)
            x, t = new, later
    return x


def _patterns(counts: np.ndarray, capacity: int, partners: int) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths that fill a sequence exactly, longest first. Every length takes its one
    partner, ``partners`` pairs of the most frequent and as many of evenly spread partners, and half as many triples, so each size of
    pattern has a share of its own, whatever the others find."""
    have, weight = counts > 0, counts.astype(float)
    have[[0, capacity]] = False
    out: set[tuple[int, ...]] = set()

    def pairs(rest: int, most: int, longest: int) -> list[tuple[int, int]]:
        x = np.arange(max(1, rest - longest), rest // 2 + 1)
        x = x[have[x] & have[rest - x]] if len(x) else x
        if len(x) > 2 * most:
            often = np.argsort(-np.minimum(weight[x], weight[rest - x]), kind="stable")[:most]
            x = x[np.unique(np.concatenate((often, np.linspace(0, len(x) - 1, most).astype(int))))]
        return [(rest - k, k) for k in x.tolist()]

    for a in np.flatnonzero(have)[::-1].tolist():
        rest = capacity - a
        if rest <= a and have[rest]:
            out.add((a, rest))
        out.update((a, *p) for p in pairs(rest, partners, a))
        third = np.flatnonzero(have[: min(a, rest - 2) + 1]) if rest > 2 else np.zeros(0, np.int64)
        for b in third[np.unique(np.linspace(0, len(third) - 1, partners).astype(int))].tolist() if len(third) else []:
            out.update(tuple(sorted((a, b, *p), reverse=True)) for p in pairs(rest - b, max(1, partners // 4), a))
    return sorted(out, reverse=True)


def _pairs(left: np.ndarray, capacity: int) -> np.ndarray:
    """For every sum the smaller length of the pair with the most left that makes it up; 0 where there is none."""
    best, have = np.zeros(capacity + 1, np.int64), left.astype(float)
    have[0] = 0
    for total in range(2, capacity + 1):
        x = np.arange(1, total // 2 + 1)
        both = np.minimum(have[x], have[total - x])
        if total % 2 == 0:
            both[-1] = have[total // 2] // 2
        k = int(both.argmax())
        best[total] = x[k] if both[k] > 0 else 0
    return best


def _drawn(left: np.ndarray, capacity: int, most: int, gap: int, rng: np.random.Generator) -> set[tuple[int, ...]]:
    """Patterns of any number of lengths, drawn as often as these are left, half of them from a given longest length on, and
    completed by the length or pair that fills them. With ``gap`` those that nothing fills stay ``gap`` short at most."""
    have = np.flatnonzero(left)
    mean = float(have @ left[have] / left.sum())
    width = int(min(4 * capacity / mean + 8, capacity))
    pair, smallest = _pairs(left, capacity), int(have[0])
    # so many patterns that their lengths stay a bounded table
    most = max(64, min(most, (1 << 21) // width))
    begun = have[::-1] if len(have) <= most // 2 else np.sort(rng.choice(have, most // 2, replace=False))[::-1]
    begun = np.repeat(begun, max(1, most // 2 // len(begun)))
    draws = rng.choice(have, size=(len(begun) + most // 2, width), p=left[have] / left[have].sum())
    coin = rng.random(draws.shape) < 0.5
    out = set()
    for k, row in enumerate(draws.tolist()):
        own = [int(begun[k])] if k < len(begun) else []
        rest = capacity - sum(own)
        for j, x in enumerate(row):
            if rest < smallest:
                break
            if left[rest] and (own and coin[k, j] or rest <= 2 * smallest):
                break
            if rest <= 2 * mean and pair[rest]:
                break
            if x <= rest:
                own.append(x)
                rest -= x
        if rest and left[rest]:
            own.append(rest)
            rest = 0
        elif rest and pair[rest]:
            own += [int(pair[rest]), rest - int(pair[rest])]
            rest = 0
        if gap and own and rest <= gap:
            out.add(tuple(sorted(own, reverse=True)))
        while gap and rest >= smallest:
            x = int(have[np.searchsorted(have, rest, side="right") - 1])
            own.append(x)
            rest -= x
        if own and rest <= gap:
            out.add(tuple(sorted(own, reverse=True)))
    return out


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, partners: int = 3, refits: int = 30) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, repeats) that use every piece of the histogram ``counts`` (index: length) once."""
    return _fitted(counts, capacity, partners, refits)[0]


def _fitted(counts: np.ndarray, capacity: int = CAPACITY, partners: int = 3, refits: int = 30) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """The plan, and how many pieces of less than a sequence the patterns left to best fit. Patterns of few lengths alone pack
    some sparse histograms better than those of any number: that plan goes where it has fewer sequences by one in 2,000, or as many
    and fewer pieces left."""
    wide, few = (_fit(counts, capacity, partners, refits, w) for w in (True, False))
    more, less = (sum(n for _, n in found[0]) for found in (wide, few))
    return few if less < 0.9995 * more or less == more and few[1] < wide[1] else wide


def _fit(counts: np.ndarray, capacity: int, partners: int, refits: int, wide: bool) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """While patterns that fill a sequence place pieces only these are used; then, where the histogram has no such ones left,
    patterns of a growing gap."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rng = np.random.default_rng(10)
    gaps, stage, total = (0, capacity // 256, capacity // 32, capacity), 0, int(left.sum())
    for _ in range(refits):
        before = int(left.sum())
        if before <= 0.01 * total:
            break
        # as many documents as a sequence must hold on average, and one more: others would leave long pieces without short ones
        fill = max(1.0, before * capacity / max(1, int(left @ np.arange(capacity + 1))))
        found = {p for p in _patterns(left, capacity, partners) if len(p) <= fill + 1}
        if wide:
            found |= _drawn(left, capacity, PATTERNS, gaps[stage], rng)
        patterns = sorted(found, reverse=True)
        if patterns:
            sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
            flat = np.fromiter((x for p in patterns for x in p), np.int64, int(sizes.sum()))
            key, uses = np.unique(np.repeat(np.arange(len(patterns)), sizes) * (capacity + 1) + flat, return_counts=True)
            index, column = key % (capacity + 1), key // (capacity + 1)
            fit = nnls(index, column, uses.astype(float), left.astype(float), len(patterns))
            at = np.searchsorted(column, np.arange(len(patterns) + 1))
            # rounded down, then, but for patterns of any gap, up where the fraction is largest and pieces are left
            rounded = [np.floor(fit + 1e-6).astype(np.int64), (fit - np.floor(fit) > 0.05).astype(np.int64)]
            order = np.argsort(-(fit - np.floor(fit)), kind="stable")
            for repeats in rounded if stage < len(gaps) - 1 else rounded[:1]:
                for k in order[repeats[order] > 0].tolist():
                    own, m = index[at[k] : at[k + 1]], uses[at[k] : at[k + 1]]
                    n = min(int(repeats[k]), int((left[own] // m).min()))
                    if n > 0:
                        plan.append((patterns[k], n))
                        left[own] -= n * m
        placed = before - int(left.sum())
        if placed < 0.04 * before:
            if not wide or stage == len(gaps) - 1 and placed < 0.02 * before:
                break
            stage = min(stage + 1, len(gaps) - 1)
    return plan + _best_fit(left, capacity), int(left.sum())


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first; each time the best filling of the rest: an exact pair if there is one, else the longest."""
    left, plan = left.copy(), []
    for a in range(capacity, 0, -1):
        while left[a]:
            left[a] -= 1
            pattern, rest = [a], capacity - a
            while rest > 0:
                fits = np.flatnonzero(left[: min(rest, capacity) + 1])
                fits = fits[fits > 0]
                if not len(fits):
                    break
                x = int(fits[-1])
                if x != rest:
                    pair = fits[(rest - fits >= fits)]
                    two = pair[(left[rest - pair] > 0) & ((rest - pair != pair) | (left[pair] > 1))]
                    x = int(rest - two[0]) if len(two) else x
                left[x] -= 1
                pattern.append(x)
                rest -= x
            uses = {x: pattern.count(x) for x in pattern}
            more = min((int(left[x]) // n for x, n in uses.items()), default=0)
            for x, n in uses.items():
                left[x] -= n * more
            plan.append((tuple(pattern), 1 + more))
    return plan


def _lookup(plan: list[tuple[tuple[int, ...], int]]):
    """For each length, the ranges of numbers of its pieces: first number, sequence of the first, offset."""
    rows = []
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, repeats in plan:
        offset = 0
        for x in pattern:
            rows.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + repeats
            offset += x
        sequence += repeats
    table = pd.DataFrame(rows, columns=["length", "number", "sequence", "offset"]).sort_values(["length", "number"])
    return {int(k): tuple(g[c].to_numpy(np.int64) for c in ("number", "sequence", "offset")) for k, g in table.groupby("length")}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset. ``pieces`` is read three times."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row for each length: at most `capacity`
        counts[r["length"]] = r["count"]
    found = _lookup(plan_packing(counts, capacity))
    # numbered in the order of lengths over range partitions; where a length begins follows from the histogram
    spread, tie, number = free_names(pieces, "_spread", "_tie", "_number")
    keyed = pieces.withColumn(spread, F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn(tie, F.monotonically_increasing_id())
    order = [F.col(c).asc() for c in ("length", spread, "doc_id", "piece", tie)]
    numbered = ordered_numbers(keyed, order, number, lambda df: materialize(df, "numbered")).drop(spread, tie)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    shipped = spark.sparkContext.broadcast((found, first))  # bounded by the plan, hence by `capacity`, not by the corpus
    schema = numbered.schema
    at_length, at_number = numbered.columns.index("length"), numbered.columns.index(number)

    def place(batches):
        plan, begins = shipped.value
        for batch in batches:
            length = batch.column(at_length).to_numpy()
            numbers = batch.column(at_number).to_numpy() - 1 - begins[length]
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if len(own):
                    first, seq, off = plan[int(length[own[0]])]
                    k = np.searchsorted(first, numbers[own], side="right") - 1
                    sequence[own] = seq[k] + numbers[own] - first[k]
                    offset[own] = off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    packed = numbered.mapInArrow(place, StructType([*schema.fields, *StructType.fromDDL("sequence_id bigint, offset bigint").fields]))
    return packed.drop(number)


def pack_documents(docs: DataFrame, *, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``; with ``keep_ids`` the rows carry their ids, ready to be written."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path=tokenizer_path, capacity=capacity, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity=capacity)


def op10_pattern_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
