"""Operator 12: source divergence audit over run-length columns.

Each language keeps the terms that occur in ``least`` of its documents. A
source of it gives every kept term the share p = 1 + floor(1e9 * (count + 2) /
(N + 2 * V)); two sources differ in a term by f = floor((p - q)^2 / (p + q)).

A source's shares are a column over the vocabulary, and most neighbours in it
can be made equal: the vocabulary is reordered so that terms of equal counts
in all sources lie together (one row with its number of terms), rows of equal
totals next to each other. The order is cut into chunks; in a chunk each
source's column is a list of runs, and for two sources the boundaries of both
lists are merged, f is computed once for each piece and multiplied by the
number of terms in it. The chunks' sums for each pair are added in Spark. No
column is ever laid out term by term for a pair, and a chunk holds one
language's sources and ``chunk`` rows at most.

Part ``pair`` has every other source of the language with the sum of f over
all kept terms; part ``term`` the terms in which a source is above its
language, the first ``top`` of them. Ranks go by value, then by the item's
UTF-8 bytes. All arithmetic is in integers.

Defined cases: null text, lang and source are ''; a source of texts without
terms is there, with N = 0; a language without kept terms (V = 0) has pairs of
value 0 and no terms; a language with one source has no pairs; repeated rows
count as often as they are there; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import slices, spread, staged, table

LEAST = 10
TOP = 10
#: Rows of the ordered vocabulary (each for all terms of the same counts) in a chunk.
CHUNK = 8192
#: Counts that a task holds before it passes them on.
HELD = 1_000_000
SCALE = 1_000_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


class _Numbers(dict):
    """Numbers of keys in order of their first sight."""

    def __missing__(self, key):
        out = self[key] = len(self)
        return out


def _added(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sum of each column for each of them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in columns)]


def _counts(held: int):
    """Texts -> (lang, source, term, n, docs), added up within a task as far as ``held`` counts allow."""

    def out(groups: _Numbers, terms: _Numbers, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        at, names = pa.array(keys >> 32), list(groups)
        said = lambda k: pa.array([x[k] for x in names], pa.string()).take(at)
        words = pa.array(list(terms), pa.binary()).cast(pa.string()).take(pa.array(keys & 0xFFFFFFFF))
        return pa.RecordBatch.from_arrays([said(0), said(1), words, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        groups, terms, waiting, size = _Numbers(), _Numbers(), [], 0
        none = np.zeros(0, np.int64)
        kept = [none, none, none]
        for part in slices(batches, 2):
            numbers, lengths = [], []
            for text in part.column(2).cast(pa.binary()):
                words = _TERM.findall(text.as_py().lower())
                numbers.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
                lengths.append(len(words))
            group = np.array([groups[x] for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
            # each term of each document once, with how often it is there
            each = np.sort((np.repeat(np.arange(len(lengths)), lengths) << 32) + np.concatenate(numbers))
            first = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else none
            keys = (group[each[first] >> 32] << 32) + (each[first] & 0xFFFFFFFF)
            waiting.append((keys, np.diff(np.append(first, len(each))), np.ones(len(first), np.int64)))
            size += len(first)
            if size > 2 * held:
                kept = _added(*(np.concatenate(c) for c in zip(kept, *waiting, strict=True)))
                waiting, size = [], 0
                if len(kept[0]) > held or len(terms) > held:
                    yield out(groups, terms, *kept)
                    groups, terms, kept = _Numbers(), _Numbers(), [none, none, none]
        kept = _added(*(np.concatenate(c) for c in zip(kept, *waiting, strict=True)))
        if len(kept[0]):
            yield out(groups, terms, *kept)

    return run


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of some counts of a group, exact at any size."""
    each, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (n + 2 * v) for c in each], np.int64)[at]


def runs(size: int, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of a column of ``size`` rows that is 0 but ``at`` some."""
    column = np.zeros(size, np.int64)
    column[at] = counts
    starts = np.append(0, np.flatnonzero(np.diff(column)) + 1)
    return starts, column[starts]


def between(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> int:
    """Sum of f over the pieces of two run lists of (starts, p); weight: terms before each row, and all."""
    starts = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], starts, "right") - 1] for x in (a, b))
    length = np.diff(weight[np.append(starts, len(weight) - 1)])
    return int((((p - q) * (p - q)) // (p + q) * length).sum())


def _chunk_sums(rows: pa.Table, header: pa.Table) -> pa.Table:
    """One chunk of a language's ordered vocabulary, and the language's sources -> the sums of f for each pair of sources, there."""
    empty = pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    if not rows.num_rows or not header.num_rows:
        return empty
    rows = rows.sort_by("at").combine_chunks()
    head = header.slice(0, 1).to_pylist()[0]
    sources = sorted((x["source"], x["n"]) for x in head["sources"])
    number = {s: i for i, (s, _) in enumerate(sources)}
    vec = rows.column("vec").combine_chunks()
    flat = vec.flatten()
    row = np.repeat(np.arange(len(vec)), np.diff(vec.offsets.to_numpy()))
    names = flat.field("source").dictionary_encode()
    source = np.array([number[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    count = flat.field("n").to_numpy(zero_copy_only=False)
    weight = np.append(0, np.cumsum(rows.column("terms").to_numpy()))
    order = np.lexsort((row, source))
    cuts = np.searchsorted(source[order], np.arange(len(sources) + 1))
    columns = []
    for i, (_, n) in enumerate(sources):
        own = order[cuts[i] : cuts[i + 1]]
        starts, values = runs(len(vec), row[own], count[own])
        columns.append((starts, shares(values, n, head["v"])))
    a, b, value = [], [], []
    for i in range(len(sources)):
        for j in range(i + 1, len(sources)):
            a.append(sources[i][0])
            b.append(sources[j][0])
            value.append(between(columns[i], columns[j], weight))
    return pa.table({"lang": pa.array([head["of"]] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, chunk: int = CHUNK, held: int = HELD) -> DataFrame:
    """-> lang, source, part ('pair' or 'term'), item, value, rank."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).alias("text"))
    each = spread(texts).mapInArrow(_counts(held), "lang string, source string, term string, n long, docs long")
    counts = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    terms = staged(terms.where(F.col("docs") >= least).select("lang", "term", "total", "vec"))

    sizes = terms.select("lang", F.explode("vec").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    groups = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = staged(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "all"))))

    # terms of the same counts in all sources are one row; rows of the same total lie together
    alike = terms.groupBy("lang", "vec").agg(F.count("*").alias("terms"), F.min("total").alias("total"))
    at = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    ordered = alike.repartitionByRange("lang", "total", "vec").sortWithinPartitions("lang", "total", "vec").withColumn("at", at)
    ordered = staged(ordered.withColumn("chunk", F.shiftright("at", 33) * (low // chunk + 1) + F.floor(F.col("at").bitwiseAND(F.lit(low)) / chunk)).select("lang", "chunk", "at", "vec", "terms"))
    lists = groups.groupBy("lang").agg(F.max("v").alias("v"), F.collect_list(F.struct("source", "n")).alias("sources"))
    heads = ordered.select("lang", "chunk").distinct().join(lists, "lang").select(F.col("lang").alias("of"), F.col("chunk").alias("part"), "v", "sources")
    sums = ordered.groupBy("lang", "chunk").cogroup(heads.groupBy("of", "part")).applyInArrow(_chunk_sums, "lang string, a string, b string, value long")

    other = groups.select("lang", F.col("source").alias("b"))
    all_pairs = groups.select("lang", F.col("source").alias("a")).join(other, "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    total = all_pairs.unionByName(sums).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(total.select("lang", "value", ends.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))

    share = lambda count, n: F.expr(f"1 + ({SCALE} * (cast({count} as decimal(20, 0)) + 2)) div ({n} + 2 * v)")
    own = terms.select("lang", F.col("term").alias("item"), "total", F.explode("vec").alias("x")).select("lang", "item", "total", "x.source", F.col("x.n").alias("count"))
    both = own.join(groups, ["lang", "source"]).select("lang", "source", "item", share("count", "n").alias("p"), share("total", "all").alias("q")).where("p > q")
    above = both.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.unionByName(ranked(above).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its terms above the language's shares."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS nl FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS ng FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.ng, 0) + 2 * v.v) AS p, 1 + (1000000000 * (k.total + 2)) // (v.nl + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 10"""
