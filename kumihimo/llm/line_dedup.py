"""Operator 3: line dedup by pairwise alignment.

Every line becomes a hash. From each line on, and up to each line, the
shortest run of lines that holds ``min_words`` words is a window: a run that
is rare, where a single line may be common. Documents that share a window
overlap. Each later document is paired with the first holder of each of its
windows (a star, so a passage that a third of all documents hold gives one
pair for each document, not all pairs). What a pair shares is aligned by
patience diff over its windows: the longest chain that increases in both
documents are blocks in order, the others are blocks that moved
(``n_moved``). The lines of all these blocks are deleted from the later
document.

Any common block of ``min_words`` words or more is a union of windows (from
its first line on, and up to each line after the first window), so none is
missed, and nothing but such blocks goes. Each deleted line has an equal line
in an earlier document, and so, link by link, in one that keeps it. Two
64-bit hashes tell windows apart. Only windows travel, never a document's
lines, and the work for a document grows with its lines.

Defined cases: null text stays null; lines are compared without the white
space at their ends; blank lines belong to the block around them; blocks
repeated only inside one document stay; documents are ordered by id, null ids
last, and by a hash of id and text where ids are equal; rows equal in both are
one document and edited alike; a document whose lines are all deleted has text
'' and n_kept 0; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import keyed, list_array, map_text, mix, row_hash, spread, staged, table

MIN_WORDS = 50

_U = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and length of the shortest runs of min_words words from each line on and up to each line, each once."""
    n = len(words)
    total = np.append(0, np.cumsum(words))
    end = np.searchsorted(total, total[:-1] + min_words)  # lines i .. end-1
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1  # lines first .. i
    on, up = np.flatnonzero(end <= n), np.flatnonzero(first >= 0)
    start, stop = np.append(on, first[up]), np.append(end[on], up + 1)
    both = np.unique(start * (n + 1) + stop)
    return both // (n + 1), both % (n + 1) - both // (n + 1)


def run_hashes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, factor: int) -> np.ndarray:
    """Hash of each run of lines."""
    n = len(hashes)
    power = np.append(_U(1), np.cumprod(np.full(n, factor, _U)))
    back = np.append(_U(1), np.cumprod(np.full(n, pow(factor, -1, 2**64), _U)))
    prefix = np.append(_U(0), np.cumsum(mix(hashes ^ _U(factor)) * power[:n]))
    return mix((prefix[start + length] - prefix[start]) * back[start] + length.astype(_U))


def increasing(pairs: list[tuple[int, int]]) -> list[bool]:
    """Patience: which of the pairs (in the order of their first part) are in a longest chain that increases in the second."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = last[at - 1] if at else -1
        tails[at : at + 1] = [j]
        last[at : at + 1] = [k]
    out = [False] * len(pairs)
    k = last[-1] if last else -1
    while k >= 0:
        out[k] = True
        k = before[k]
    return out


def _lines(min_words: int):
    def make():
        digest = xxhash.xxh3_64_intdigest

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for text in part.column(1).to_pylist():
                lines = [x.strip() for x in text.split("\n")] if text is not None else []
                h = np.array([digest(x.encode("utf-8", "surrogatepass")) for x in lines], _U)
                start, length = windows(np.array([len(x.split()) for x in lines], np.int64), min_words)
                for c, x in zip(columns, (run_hashes(h, start, length, _FACTORS[0]), run_hashes(h, start, length, _FACTORS[1]), start, length), strict=True):
                    c.append(x)
            lists = [list_array(c, np.uint64, pa.uint64()).values.view(pa.int64()) for c in columns]
            offsets = list_array(columns[0], np.uint64, pa.uint64()).offsets
            held = pa.StructArray.from_arrays([lists[0], lists[1], lists[2].cast(pa.int32()), lists[3].cast(pa.int32())], names=["h", "g", "at", "n"])
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, held)], names=["doc_id", "row", "windows"])

        return f

    return make


def shared_lines(matches: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, int]:
    """From one document's matched windows (first holder, line, lines, line in the holder): which lines go, up to the last of them, and how many of these moved."""
    matches = sorted(matches)
    size = max(at + n for _, at, n, _ in matches)
    gone, ordered = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    lo = 0
    while lo < len(matches):
        hi = lo
        while hi < len(matches) and matches[hi][0] == matches[lo][0]:
            hi += 1
        own = matches[lo:hi]
        for (_, at, n, _), kept in zip(own, increasing([(at, j) for _, at, _, j in own]), strict=True):
            for marks in (gone, ordered) if kept else (gone,):
                marks[at] += 1
                marks[at + n] -= 1
        lo = hi
    gone, ordered = np.cumsum(gone)[:-1] > 0, np.cumsum(ordered)[:-1] > 0
    return gone, int((gone & ~ordered).sum())


def _align(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            made = [shared_lines([(m["first"], m["at"], m["n"], m["j"]) for m in found]) for found in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tolist() for g, _ in made], pa.list_(pa.bool_())), pa.array([m for _, m in made], pa.int64())], names=["row", "gone", "moved"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """row (key by id and text), gone (of its lines up to the last that goes, which go), moved: for each document that repeats an earlier one's block."""
    held = staged(map_text(spread(keyed(docs, id_col, text_col)), _lines(min_words), "doc_id long, row long, windows array<struct<h:long,g:long,at:int,n:int>>"))
    each = held.select("doc_id", "row", F.explode("windows").alias("w")).select("doc_id", "row", "w.h", "w.g", "w.at", "w.n")
    # what more than one document holds, and its first holder, who comes by id, then by row
    twice = each.groupBy("h", "g").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")).alias("lead")).where("low < high")
    leads = twice.select("h", "g", F.col("lead.row").alias("first"), F.col("lead.at").alias("j"))
    matched = each.join(leads, ["h", "g"]).where("row <> first")
    return matched.groupBy("row").agg(F.collect_set(F.struct("first", "at", "n", "j")).alias("found")).mapInArrow(_align, "row long, gone array<boolean>, moved long")


def _edited(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``docs`` with the blocks gone from ``text_col``, and __n_lines, __n_kept, __n_moved."""
    gone = repeated_lines(docs, id_col, text_col, min_words).select(F.col("row").alias("__row"), F.col("gone").alias("__gone"), F.col("moved").alias("__moved"))
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.coalesce(F.get("__gone", i), F.lit(False)))
    joined = docs.withColumn("__key", row_hash(id_col, text_col)).join(gone, F.col("__key") == F.col("__row"), "left")
    changed, none = F.col("__gone").isNotNull(), F.lit(0).cast("long")
    size = F.when(F.col(text_col).isNull(), none).otherwise(F.size(split).cast("long"))
    return joined.select(
        *[F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        size.alias("__n_lines"),
        F.when(changed, F.size(kept).cast("long")).otherwise(size).alias("__n_kept"),
        F.coalesce("__moved", none).alias("__n_moved"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` stripped of blocks that an earlier document holds, and n_lines, n_kept, n_moved (longs, in place of columns so named)."""
    made = ("n_lines", "n_kept", "n_moved")
    kept = [c for c in docs.columns if c not in made]
    return _edited(docs.select(kept), id_col, text_col, min_words).select(*kept, *[F.col(f"__{c}").alias(c) for c in made])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (without blocks of 50 words or more that an earlier document holds), n_lines, n_kept, n_moved."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Pipeline stage: texts without repeated blocks; a document left without a line goes, as its whole text stays elsewhere. n_chars follows the text."""
    out = _edited(docs, "doc_id", "text", min_words).where("__n_kept > 0 or __n_lines = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
