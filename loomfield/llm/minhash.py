"""MinHash near-dedup by tensored banding: table keys are pairs from two small collections of minhash bands.

A set of shingles gets two collections of ``m`` bands of ``ROWS`` minhashes each, and the m * m table keys are all pairs
of a band of the first and a band of the second. So keys of 2 * ROWS minhashes for m * m tables cost
2 * m * ROWS minhashes, about the square root of the 2 * m * m * ROWS that independent tables take. Two
sets of similarity s share a key unless one of the collections has no band in common, which happens with a chance of
at most 2 * (1 - s ** ROWS) ** m; ``m`` follows from the threshold so that this stays under ``MISS``.

A band that only one set has can be part of no shared key. So bands are counted first, and keys are formed of
the bands that several sets have; sets that resemble nothing form none. Documents of one key are compared as in the
n-gram Jaccard join: equal sets are one node, the smallest node of a key with all others, then groups
that still hold several components by bounds on count vectors, and every link is confirmed on the full sets.

A null, empty or wordless text has an empty set, links with nothing and is its own component. Fewer words than
``size`` make one shingle. Repeated rows and ties fall into one node; a node's id is its smallest doc_id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .jaccard import _components_of
from .shared import arrow_rows, materialize, spread_join, table

SIZE = 5
PERCENT = 80
#: Minhashes of a band.
ROWS = 2
#: Chance, at most, that a pair right at the threshold shares no key.
MISS = 1e-6
SEED = 12
#: Shingles that are hashed by all functions at once.
CHUNK = 2048


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of a collection so that a pair at the threshold shares no key with a chance of at most ``miss``."""
    alike = (percent / 100) ** rows
    return 1 if alike >= 1 else max(1, math.ceil(math.log(miss / 2) / math.log(1 - alike)))


class Bands:
    """Both collections' bands of a set, one after the other, as 64-bit values that tell their place."""

    def __init__(self, percent: int):
        self.m = bands_for(percent)
        n = 2 * self.m * ROWS
        rng = np.random.default_rng(SEED)
        self.times = rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
        self.plus = rng.integers(0, 1 << 64, n, np.uint64)
        self.place = T.mix(np.arange(1, 2 * self.m + 1, dtype=np.uint64))

    def minhashes(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max)
        for lo in range(0, len(grams), CHUNK):
            least = np.minimum(least, (grams[lo : lo + CHUNK, None] * self.times + self.plus).min(0))
        return least

    def of(self, grams: np.ndarray) -> np.ndarray:
        least = self.minhashes(grams).reshape(2 * self.m, ROWS)
        key = self.place.copy()
        for k in range(ROWS):
            key = T.mix(key ^ least[:, k])
        return key


def tensored_tokens(m: int):
    """Tokens of all nodes from their bands ``routes``: pairs of a band of each collection that other nodes have too."""

    def tokens(routed: DataFrame) -> DataFrame:
        bands = routed.select("node", F.posexplode("routes").alias("place", "band"))
        several = materialize(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "bands")
        live = spread_join(bands, several.select("band"), "band", several, "node")
        side = lambda first: F.collect_list(F.when((F.col("place") < m) == F.lit(first), F.col("band")))
        both = live.groupBy("node").agg(side(True).alias("x"), side(False).alias("y"))  # at most m of each
        pairs = both.select("node", F.explode("x").alias("x"), "y").select("node", "x", F.explode("y").alias("y"))
        return materialize(pairs.select("node", F.xxhash64("x", "y").alias("token")), "tokens")  # read twice

    return tokens


def minhash_components(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); other columns are not read."""
    with arrow_rows(docs.sparkSession, 1000):
        return _components_of(docs, size, percent, router=Bands, tokens_of=tensored_tokens(bands_for(percent))).drop("component")


def op12_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    found = minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP12_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
s as (
  select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as g
  from d, unnest(range(1, greatest(2, len(w) - 3))) as t(i) where len(w) > 0
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, m) as (select doc_id, doc_id from d union select e.b, r.m from r join e on e.a = r.doc_id),
c as (select doc_id, min(m) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from d left join n using (doc_id) join c using (doc_id)
"""
