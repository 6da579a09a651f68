"""Operator 4: n-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. In each of ``runs`` independent
runs a set keeps the shingles whose hash under the run falls below
1 / (t * |set|), t being the wanted similarity: each kept shingle is a path,
and sets that keep the same one meet in its bucket. Two sets of similarity t
or more share t*|larger| shingles or more, so they share a path with
probability 1 - 1/e or more in each run.

Buckets of at most ``leaf`` sets are compared whole, by one-permutation
sketches: how many bins must agree follows from both set sizes, so that a pair
at the threshold is lost with a chance below LOSS at any size. A larger bucket
is held against a few representatives, and what they leave open is split by
one more sampled token and held against more of them, until each set of a
bucket is in its one component or has met all others (:func:`similar.joined`).
None is capped.

The candidate links make clusters, and these are compared exactly, on the
shingles, all with all: a cluster whose sets times shingles are at most
``work`` in one task, a larger one in blocks, a task for each pair of blocks.

Result: one row for each row. ``n_links`` counts the other texts of similarity
t or more, all of them at any size; so the work in a cluster of different near
copies grows with its square, though never the rows. ``class_id`` joins what
links connect.

Defined cases: null and wordless texts have no shingles, link to nothing and
are their own class; a text of one to four words is one shingle; texts with
the same shingle set are copies (Jaccard 1) and share a class without being
expanded into pairs; rows are told apart by id and text together, so null ids
and ids shared by different texts do no harm (a class whose ids are all null
has a null class_id); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .similar import HELD, WORK, Exact, agreeing, compared_in_blocks, compared_whole, joined, longs, needed
from .text import WORD, WordHashes, keyed, map_text, mix, row_hash, shingles, spread, staged, table

K = 5
THRESHOLD = 0.8
RECALL = 0.9999998
LEAF = 4096
BINS = 128
#: Chance that the sketches of a pair at the threshold agree in fewer bins than _cuts asks for its sizes.
LOSS = 1e-7
#: Sums of two set sizes up to here have a cut of their own; larger ones use the last, which asks no more than theirs would.
SUMS = 4096
#: Runs of the split of a bucket that representatives do not settle.
SPLITS = 3
#: Sketches that a task holds at a time when it compares members with representatives.
HELD_SKETCHES = 1 << 12

_U = np.uint64


def shingle_set(text: str | None, cache: WordHashes, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    return np.unique(shingles(cache.array(WORD.findall(text)), k)) if text else np.zeros(0, _U)


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation minhash: a byte of the least hash in each of BINS bins; an empty bin borrows from the next filled one."""
    h = np.sort(mix(tokens ^ _U(0x5851F42D4C957F2D)))
    edges = np.arange(BINS, dtype=_U) << _U(57)
    at = np.searchsorted(h, edges)
    filled = at < np.append(at[1:], len(h))
    where = np.flatnonzero(filled)
    nearest = where[np.searchsorted(where, np.arange(BINS)) % len(where)]
    gap = (nearest - np.arange(BINS)) % BINS
    return (mix(h[at[nearest]] + gap.astype(_U) * _U(0x9E3779B97F4A7C15)) & _U(255)).astype(np.uint8).tobytes()


@lru_cache(maxsize=4)
def _cuts(threshold: float) -> np.ndarray:
    """By the sum of two set sizes, up to SUMS: the bins that must agree.

    A bin holds the next hash after its edge, so two sets agree where the next
    hash of their union is a shared one. With d of n hashes not shared, the
    part of the circle before shared ones is Beta(n - d, d); the agreeing
    bins vary less than BetaBinomial(BINS, n - d, d), whose tail is cut at LOSS.
    """
    sums = np.arange(SUMS + 1)
    both = needed(sums, threshold)
    apart = sums - 2 * both
    out = np.full(SUMS + 1, BINS, np.int64)  # nothing apart: only equal sets reach the threshold, or none
    log = np.append(0.0, np.cumsum(np.log(np.arange(1, SUMS + BINS + 2))))  # of factorials
    some = (apart > 0) & (both > 0)
    a, b, c = both[some][:, None], apart[some][:, None], np.arange(BINS + 1)[None, :]
    beta = lambda x, y: log[x - 1] + log[y - 1] - log[x + y - 1]
    p = np.exp(log[BINS] - log[c] - log[BINS - c] + beta(a + c, b + BINS - c) - beta(a, b))
    out[some] = (np.cumsum(p, 1) <= LOSS).sum(1)
    return out


def _limit(sizes: np.ndarray | int, threshold: float) -> np.ndarray:
    """The hash below which a shingle of a set of that size is kept: a share of 1 / (t * size)."""
    p = 1.0 / (threshold * np.asarray(sizes, np.float64))
    return np.where(p >= 1, _U(2**64 - 1), (np.minimum(p, 0.999) * 2.0**64).astype(_U))


def _child(tokens: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(mix(tokens) + key)


def paths(tokens: np.ndarray, seeds: np.ndarray, threshold: float) -> np.ndarray:
    """Path keys over all runs."""
    run, at = np.nonzero(mix(tokens[None, :] ^ seeds[:, None]) <= _limit(len(tokens), threshold))
    return _child(tokens[at], seeds[run])


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95))


def _sketch_rows(runs: int, threshold: float, k: int):
    def make():
        cache, seeds = WordHashes(), _seeds(runs)

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            prints, sizes, sketches, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(text, cache, k)
                sizes.append(len(s))
                if not len(s):
                    prints.append(None)
                    sketches.append(None)
                    keys.append(s)
                    continue
                a, b = mix(s), mix(s ^ _U(0xA0761D6478BD642F))
                prints.append(f"{len(s):x}.{int(a.sum(dtype=_U)):016x}{int(np.bitwise_xor.reduce(b)):016x}{int(b.sum(dtype=_U)):016x}")
                sketches.append(sketch(s))
                keys.append(paths(s, seeds, threshold))
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(prints, pa.string()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), longs(keys)],
                names=["doc_id", "row", "print", "n_shingles", "data", "keys"],
            )

        return f

    return make


class Sketched:
    """Sets by their sketches, which decide who may be similar."""

    step = 256

    def __init__(self, sizes: np.ndarray, data: pa.Array, threshold: float):
        self.sizes, self.threshold = sizes, threshold
        self.rows = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, BINS)

    def one(self, lead: int, others: np.ndarray) -> np.ndarray:
        sums = self.sizes[others] + self.sizes[lead]
        fit = np.minimum(self.sizes[others], self.sizes[lead]) >= needed(sums, self.threshold)
        return fit & (agreeing(self.rows, self.rows[others], lead) >= _cuts(self.threshold)[np.minimum(sums, SUMS)])

    def near(self, leads: np.ndarray) -> np.ndarray:
        out = np.zeros((len(leads), len(self.sizes)), bool)
        step = max(1, (1 << 15) // max(1, len(self.sizes)))
        for lo in range(0, len(leads), step):
            some = leads[lo : lo + step]
            sums = self.sizes[some][:, None] + self.sizes[None, :]
            same = agreeing(self.rows, self.rows, some)
            out[lo : lo + step] = (same >= _cuts(self.threshold)[np.minimum(sums, SUMS)]) & (np.minimum(self.sizes[some][:, None], self.sizes[None, :]) >= needed(sums, self.threshold))
        return out

    def split(self, seeds: np.ndarray) -> list[np.ndarray]:
        """Next keys of each set: the bins of the sketch are the tokens."""
        tokens = mix(self.rows.astype(_U) + (np.arange(BINS, dtype=_U) << _U(8)))
        hit = mix(tokens[:, None, :] ^ seeds[None, :, None]) <= _limit(BINS, self.threshold)
        return [_child(np.broadcast_to(t, h.shape)[h], np.repeat(seeds, h.sum(1))) for t, h in zip(tokens, hit, strict=True)]


def _links(docs: DataFrame, threshold: float, k: int, recall: float, leaf: int, work: int, held: int) -> tuple[DataFrame, DataFrame]:
    """-> rows (doc_id, row, print, n_shingles) and known (print, first_id, n_copies, class, n_links); class is a row key."""
    runs = max(1, math.ceil(-math.log(1 - recall)))
    seen = staged(map_text(spread(docs), _sketch_rows(runs, threshold, k), "doc_id long, row long, print string, n_shingles long, data binary, keys array<long>"))
    rows = seen.select("doc_id", "row", "print", "n_shingles")
    copies = rows.where("print is not null").groupBy("print").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    # one row for each different set
    mine = copies.select(F.col("print").alias("__print"), "rep")
    sets = staged(seen.join(mine, (F.col("print") == F.col("__print")) & (F.col("row") == F.col("rep"))).select("rep", F.col("n_shingles").alias("size"), "data", "keys").dropDuplicates(["rep"]))
    sketches = sets.select("rep", "data")

    one = sets.select("rep", "size", F.explode("keys").alias("key"))
    # paths on which the same sets meet are one bucket: they agree in count and in two folded hashes
    fold = lambda seed: F.bit_xor(F.xxhash64("rep", F.lit(seed)))
    met = one.groupBy("key").agg(F.count("*").alias("n"), fold(1).alias("h"), fold(2).alias("g")).where("n > 1").groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key", "n")
    shared = staged(one.join(met, "key"))
    leaves = shared.where(F.col("n") <= leaf).join(sketches, "rep")
    edges = compared_whole(leaves, Sketched, threshold).select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    large = shared.where(F.col("n") > leaf).select("key", "rep", "size")
    # those that are in most of the large buckets lead first: what many others vary
    often = large.groupBy("rep").agg(F.count("*").alias("score"))
    more = joined(large.join(often, "rep").withColumn("held", F.lit(1).cast("long")), sketches, Sketched, threshold, leaf * leaf, max(leaf, HELD_SKETCHES), SPLITS)
    found = components(edges.unionByName(more))

    clusters = found.groupBy("class").agg(F.count("*").alias("n"))
    members = found.join(clusters, "class").select(F.col("node").alias("rep"), F.col("class").alias("key"), "n")

    def tokens():
        cache = WordHashes()

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = [shingle_set(t, cache, k) for t in part.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(0), longs(lists), pa.array([len(x) for x in lists], pa.int64()), part.column(2), part.column(3)], names=["rep", "data", "size", "key", "n"])

        return f

    # members grow with the input, so the join is never a broadcast one; equal rows have one key and count once
    texts = docs.join(members.hint("merge"), docs["row"] == members["rep"]).dropDuplicates(["rep"]).select("rep", "text", "key", "n")
    full = staged(map_text(texts, tokens, "rep long, data array<long>, size long, key long, n long"))
    totals = full.groupBy("key").agg(F.sum("size").alias("total"))
    sized = full.join(totals, "key")
    fits = (F.col("n") * F.col("total") <= work) & (F.col("total") <= held)
    met = staged(compared_whole(sized.where(fits), Exact, threshold, counting=True).unionByName(compared_in_blocks(sized.where(~fits), Exact, threshold, held)))
    counts = met.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    links = met.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    classes = components(links).withColumnRenamed("node", "rep")
    known = copies.join(counts, "rep", "left").join(classes, "rep", "left")
    return rows, known.select("print", "first_id", "n_copies", F.coalesce("class", "rep").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K, recall: float = RECALL, leaf: int = LEAF, work: int = WORK, held: int = HELD) -> DataFrame:
    """-> doc_id, n_shingles, rep_id (least id with the same shingle set), n_copies, n_links (other texts linked to), class_id.

    class_id is the least id of the connected component of links of similarity
    ``threshold`` or more. ``recall``: chance that a given pair at the
    threshold meets in a bucket.
    """
    rows, known = _links(keyed(docs, id_col, text_col), threshold, k, recall, leaf, work, held)
    least = known.groupBy("class").agg(F.min("first_id").alias("class_id"))
    out = rows.join(known.join(least, "class"), "print", "left")
    alone = F.col("print").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("rep_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class under five-word Jaccard of 0.8 or more, and its links to different texts."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL, leaf: int = LEAF, work: int = WORK, held: int = HELD) -> DataFrame:
    """Pipeline stage: of each class the row with the least id stays (null ids last; of several rows with that id, one); wordless rows stay, equal ones once."""
    rows, known = _links(keyed(docs), threshold, k, recall, leaf, work, held)
    least = known.groupBy("class").agg(F.min("first_id").alias("class_id"))
    first = rows.join(known.join(least, "class"), "print").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("row").alias("__row")).select("__row")
    keep = first.unionByName(rows.where("print is null").select(F.col("row").alias("__row"))).distinct()
    return docs.withColumn("__key", row_hash()).join(keep, F.col("__key") == F.col("__row"), "left_semi").dropDuplicates(["__key"]).select(docs.columns)
