"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions only.

Texts are folded (A-Z to a-z) and cut into words. A shared run of
``window`` = 10 words holds 10 - k + 1 overlapping k-grams, so winnowing with
that many k-grams to a sliding window keeps the same least hash on both
sides: every shared run has a common fingerprint. Fingerprints of documents
and of benchmark items are joined; in the documents that are hit the hits are
extended: all their runs of ``window`` words meet those of the items in an
equi-join on two 64-bit hashes, so neither a chance equality of fingerprints
nor a shorter overlap counts. Items of fewer words are one window each; their
hash is sought among all runs of that length.

What is joined are positions and hashes, never an item's words for each
document. Benchmark sides are broadcast only where their bytes are summed up
to be at most ``BROADCAST_BYTES``; beyond it the joins are shuffled ones.

Defined cases: null and wordless texts hit nothing and have n_words 0; an
item without words is never found, a null item_id counts as ''; rows are told
apart by id and text, so null and shared ids do no harm; repeated rows and
items count each (n_items counts item ids once); an empty benchmark leaves all
clean; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import keyed, row_hash, staged, table

WINDOW = 10
K = 5
BROADCAST_BYTES = 16 << 20

_NOTHING = hashlib.sha256(b"").hexdigest()
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased (ASCII) words: runs of anything but ASCII characters that are neither letters nor digits."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), "")


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once for a row; a plain reference would be inlined into each lambda and run again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _up_to(n: Column) -> Column:
    """[0 .. n-1], empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def grams(w: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    return F.transform(_up_to(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _distinct_grams(k: int):
    return lambda w: F.array_distinct(grams(w, k))


def winnow(g: Column, size: int) -> Column:
    """The least hash of each run of ``size`` k-gram hashes, each once."""
    least = F.transform(_up_to(F.size(g) - (size - 1)), lambda i: F.array_min(F.slice(g, i + 1, size)))
    return F.array_distinct(least)


def runs(w: Column, n: int) -> Column:
    """(s, h, g) of all runs of n words: where each begins, and two hashes of its words."""
    at = lambda i: [F.get(w, i + j) for j in range(n)]
    return F.transform(_up_to(F.size(w) - (n - 1)), lambda i: F.struct(i.alias("s"), F.xxhash64(*at(i)).alias("h"), F.xxhash64(F.lit(n), *at(i)).alias("g")))


def _small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast if its rows, of an item_id and numbers, sum up to at most so many bytes."""
    size = df.agg(F.sum(F.length("item_id").cast("long") * 4 + 64)).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of ``docs``."""
    return _judged(docs, items, id_col, text_col, item_col, window, k).drop("row")


def _judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, k: int = K) -> DataFrame:
    tests = staged(
        items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    )
    short = sorted(r[0] for r in tests.where(F.size("w") < window).select(F.size("w")).distinct().collect())  # at most window - 1 numbers
    span = window - k + 1
    # what marks a document: winnowed k-grams for whole windows, and all runs as long as a short item
    whole = F.size("w") >= window
    keyed_marks = F.when(whole, winnow(grams(F.col("w"), k), span)).otherwise(_choose(short, lambda n: grams(F.col("w"), n)))
    keys = staged(tests.select("item_id", F.least(F.size("w"), F.lit(window)).alias("n"), F.explode(keyed_marks).alias("mark")).distinct())
    narrow = keyed(docs, id_col, text_col)
    fingerprints = _let(words(F.col("text")), lambda w: _let(grams(w, k), lambda g: winnow(g, span)))
    marks = narrow.select("row", F.lit(window).alias("n"), F.explode(fingerprints).alias("mark"))
    for n in short:
        marks = marks.unionByName(narrow.select("row", F.lit(n).alias("n"), F.explode(_let(words(F.col("text")), _distinct_grams(n))).alias("mark")))
    hit = staged(marks.join(_small(keys), ["n", "mark"], "left_semi").select("row").distinct())

    # windows of the items, and of the documents that share a fingerprint with one
    item_runs = F.when(whole, runs(F.col("w"), window)).otherwise(_choose(short, lambda n: runs(F.col("w"), n), "array<struct<s:int,h:bigint,g:bigint>>"))
    own = tests.select("item_id", F.least(F.size("w"), F.lit(window)).alias("n"), F.explode(item_runs).alias("x")).select("item_id", "n", "x.h", "x.g").distinct()
    own = staged(own)
    texts = narrow.join(hit, "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("w"))
    texts = staged(texts)
    found = None
    for n in (window, *short):
        part = texts.select("row", F.lit(n).alias("n"), F.explode(runs(F.col("w"), n)).alias("x")).select("row", "n", "x.s", "x.h", "x.g")
        found = part if found is None else found.unionByName(part)
    met = staged(found.join(_small(own), ["n", "h", "g"]).select("row", "s", "n", "item_id"))
    return _counted(narrow, met)


def _counted(narrow: DataFrame, met: DataFrame) -> DataFrame:
    """Words under windows and items found, beside each document's words. met: row, s, n, item_id of each window found."""
    # windows in order of their begin: each adds what lies beyond the farthest end so far
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"))
    spans = met.select("row", F.struct(F.col("s").cast("long").alias("s"), (F.col("s") + F.col("n")).cast("long").alias("e")).alias("x")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    hits = spans.select("row", F.aggregate("xs", begin, step)["n"].alias("n_hit"))
    names = met.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("names"))
    names = names.select("row", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    sizes = narrow.select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return sizes.join(hits.join(names, "row"), "row", "left").select(
        "doc_id", "row", "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_NOTHING)).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def _choose(short: list[int], make, kind: str = "array<bigint>") -> Column:
    """make(n) for the item's own length n among ``short``."""
    out = F.lit(None).cast(kind)
    for n in short:
        out = F.when(F.size("w") == n, make(n)).otherwise(out)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM dwin d JOIN iwin i ON d.n = i.n AND d.run = i.run),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Pipeline stage: documents that hold a window of a benchmark item go."""
    dirty = _judged(docs, items, window=window, k=k).where("contaminated").select(F.col("row").alias("__row")).distinct()
    return docs.join(dirty, row_hash() == F.col("__row"), "left_anti").select(docs.columns)
