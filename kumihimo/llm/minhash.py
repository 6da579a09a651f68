"""Operator 11: MinHash near-dedup by min-max hashing.

A text, lower-cased in A-Z, is the set of its three-word shingles. Each of
PERMUTATIONS hash functions runs once over a set and gives two values of its
signature, the least hash and the greatest: half the evaluations of a
signature of that length, and as a differing shingle can't be both, the share
of agreeing values varies less than that of independent ones and stays
unbiased. Bands of ROWS values are buckets; a pair at the threshold t misses
all of them with a chance of (1 - t^ROWS)^BANDS, 4e-7 here.

Sets that meet in a bucket are held against each other by their signatures,
at a cut that loses a pair at the threshold with a chance below LOSS; what
remains makes clusters. In these every link is confirmed on the full sets,
and a cluster ends when each set is in its one component or has met all
others (:func:`similar.joined`), so no link that joins anything is lost and
no bucket or cluster is capped. Equal sets meet before, by 128-bit prints.

Result: one row for each row. ``component_id`` is the least doc_id reachable
over links of 100 * |intersection| >= 85 * |union|, itself included, and
``kept`` says that it is the row's own.

Defined cases: null, empty and wordless texts have an empty set (n_shingles
0), link to nothing and are kept; a text of one or two words is one shingle,
the whole sequence, equal to no shingle of three; texts are told apart by two
64-bit hashes of the text, so repeated rows, null ids and ids that different
texts share do no harm: such rows share what their texts have, a null id is
never the least, and a component whose ids are all null has a null
component_id and keeps its rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .similar import HELD, WORK, Exact, agreeing, compared_whole, joined, longs, needed
from .text import WordHashes, map_text, mix, shingles, spread, staged, table

K = 3
THRESHOLD = 0.85
#: Hash functions; a signature has two values of each.
PERMUTATIONS = 64
#: Bands of so many values each; the values left over are in signatures only.
BANDS, ROWS = 25, 5
#: Chance that the signatures of a pair at the threshold agree in fewer values than are asked for.
LOSS = 1e-7
#: A bucket of at most so many sets is compared whole, by signatures.
LEAF = 4096

_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(WordHashes):
    """Of words as bytes."""

    def __missing__(self, word: bytes) -> int:
        return super().__missing__(word.decode("utf-8", "surrogatepass"))


def shingle_set(text: str | None, cache: dict, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text whose A-Z are lower-cased."""
    return np.unique(shingles(cache.array(_WORD.findall(text.encode("utf-8", "surrogatepass").lower())), k)) if text else np.zeros(0, _U)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each permutation of 64-bit values: what to flip and an odd factor."""
    at = np.arange(1, n + 1, dtype=_U)
    return mix(at * _U(0x9E3779B97F4A7C15)), mix(at * _U(0xD1342543DE82EF95)) | _U(1)


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least and greatest hash under each permutation, for sets with a shingle: [set, 2 * permutations]."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), _U)
    for p, (flip, factor) in enumerate(zip(*_functions(permutations), strict=True)):
        h = (flat ^ flip) * factor
        out[:, 2 * p] = np.minimum.reduceat(h, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[set, bands]. Values of a band are ``bands`` apart, so that the two of one permutation are in different bands."""
    out = np.repeat(mix(np.arange(1, bands + 1, dtype=_U))[None, :], len(values), 0)
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + values[:, r * bands : (r + 1) * bands])
    return out


@lru_cache(maxsize=4)
def cut(threshold: float, n: int = 2 * PERMUTATIONS) -> int:
    """Values that must agree: fewer have a chance below LOSS for a pair at the threshold, by the binomial tail, which is wider than theirs."""
    tail = 0.0
    for k in range(n + 1):
        tail += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if tail > LOSS:
            return k
    return n


class Signed:
    """Sets by a byte of each value of their signatures."""

    step = 256

    def __init__(self, sizes: np.ndarray, data: pa.Array, threshold: float):
        self.sizes, self.threshold = sizes, threshold
        self.rows = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(sizes), -1)

    def one(self, lead: int, others: np.ndarray) -> np.ndarray:
        sums = self.sizes[others] + self.sizes[lead]
        fit = np.minimum(self.sizes[others], self.sizes[lead]) >= needed(sums, self.threshold)
        return fit & (agreeing(self.rows, self.rows[others], lead) >= cut(self.threshold))

    def near(self, leads: np.ndarray) -> np.ndarray:
        out = np.zeros((len(leads), len(self.sizes)), bool)
        step = max(1, (1 << 15) // max(1, len(self.sizes)))
        for lo in range(0, len(leads), step):
            some = leads[lo : lo + step]
            sums = self.sizes[some][:, None] + self.sizes[None, :]
            fit = np.minimum(self.sizes[some][:, None], self.sizes[None, :]) >= needed(sums, self.threshold)
            out[lo : lo + step] = fit & (agreeing(self.rows, self.rows, some) >= cut(self.threshold))
        return out


def _signed_rows(k: int):
    def make():
        cache = _Hashes()

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, cache, k) for t in part.column(1).to_pylist()]
            prints = [f"{int(mix(s).sum(dtype=_U)):016x}{int(mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)):016x}{len(s):x}" if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            data, keys = iter(()), iter(())
            if full:
                values = signatures(full)
                data = iter((mix(values) & _U(255)).astype(np.uint8))
                keys = iter(band_keys(values))
            none = np.zeros(0, _U)
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(prints, pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(data).tobytes() if len(s) else None for s in sets], pa.binary()), longs([next(keys) if len(s) else none for s in sets])],
                names=["doc_id", "h1", "h2", "print", "size", "data", "keys"],
            )

        return f

    return make


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K, leaf: int = LEAF, work: int = WORK, held: int = HELD) -> DataFrame:
    """-> doc_id, n_shingles, component_id, kept."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2"))
    seen = staged(map_text(spread(rows), _signed_rows(k), "doc_id long, h1 long, h2 long, print string, size long, data binary, keys array<long>"))
    # one row for each different set, numbered; written once, so that its numbers stay
    copies = seen.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("h1", "h2", "size", "data", "keys")).alias("one"))
    sets = staged(copies.select(F.monotonically_increasing_id().alias("rep"), "print", "first_id", "one.*"))

    one = sets.select("rep", "size", F.explode("keys").alias("key"))
    # buckets in which the same sets meet are one: they agree in count and in two folded hashes
    fold = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("rep")))
    met = one.groupBy("key").agg(F.count("*").alias("n"), fold(1).alias("h"), fold(2).alias("g")).where("n > 1").groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key", "n")
    shared = staged(one.join(met, "key"))
    data = sets.select("rep", "data")
    leaves = compared_whole(shared.where(F.col("n") <= leaf).join(data, "rep"), Signed, threshold).select(F.col("rep").alias("a"), F.col("root").alias("b"))
    large = shared.where(F.col("n") > leaf).select("key", "rep", "size")
    often = large.groupBy("rep").agg(F.count("*").alias("score"))
    more = joined(large.join(often, "rep").withColumn("held", F.lit(1).cast("long")), data, Signed, threshold, leaf * leaf, leaf)
    found = components(leaves.unionByName(more)).select(F.col("node").alias("rep"), F.col("class").alias("key"))

    def tokens():
        cache = _Hashes()

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = [shingle_set(t, cache, k) for t in part.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(0), longs(lists), pa.array([len(x) for x in lists], pa.int64()), part.column(2)], names=["rep", "data", "size", "key"])

        return f

    # members grow with the input, so their joins are never broadcast ones
    members = found.join(sets.select("rep", "h1", "h2").hint("merge"), "rep").withColumnsRenamed({"h1": "m1", "h2": "m2"})
    texts = rows.join(members.hint("merge"), (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))).dropDuplicates(["rep"]).select("rep", "text", "key")
    full = staged(map_text(texts, tokens, "rep long, data array<long>, size long, key long"))
    links = joined(full.select("key", "rep", "size", F.col("size").alias("held"), F.col("size").alias("score")), full.select("rep", "data"), Exact, threshold, work, held)
    classes = components(links).select(F.col("node").alias("rep"), F.col("class").alias("root"))
    known = sets.select("rep", "print", "first_id").join(classes, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = known.groupBy("root").agg(F.min("first_id").alias("least"))
    of_print = known.join(least, "root").select("print", "least")
    out = seen.select("doc_id", "size", "print").join(of_print, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its set's size, the least id of its component, and whether it is that one."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, len(sh) AS m, unnest(sh) AS x FROM s),
t AS (SELECT x, row_number() OVER () AS i FROM (SELECT x FROM e GROUP BY x HAVING count(*) > 1) q),
o AS (SELECT doc_id, m, i FROM e JOIN t USING (x)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.m AS m, b.m AS o, count(*) AS k FROM o a JOIN o b ON a.i = b.i AND a.doc_id < b.doc_id AND 100 * least(a.m, b.m) >= 85 * greatest(a.m, b.m) GROUP BY 1, 2, 3, 4),
h AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (m + o - k)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT r.doc_id, n.n AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept FROM r JOIN n USING (doc_id) GROUP BY r.doc_id, n.n"""
