"""Shared helpers: Arrow batches cut to a bounded size, words, hashes, staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row by id and text, nulls included: decisions on rows travel by it where ids may be null or shared."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the row's key alone."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(id_col, text_col).alias("row"))


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``rows`` rows and about ``size`` bytes of one text column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, done + size, "right")), at + rows, n)
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: int = 1, rows: int = 512, size: int = 4 << 20) -> DataFrame:
    """mapInArrow over bounded slices. ``make()`` runs once in each task and returns the function of a slice."""

    def run(batches):
        f = make()
        for part in slices(batches, column, rows, size):
            out = f(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, from batches sorted by them; a group may span batches."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all of them when it holds ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return out

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; a shorter text with words has one window, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    m = n - k + 1
    acc = np.full(m, k, _U)
    for i in range(k):
        acc = acc * _U(0x9E3779B97F4A7C15) + hashes[i : i + m]
    return mix(acc)


def list_array(parts: list[np.ndarray], dtype, kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a fresh local one only where that is unset and Spark is local."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("kumihimo.shared.dir", None)
    if not at:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-kumihimo-")
        spark.conf.set("kumihimo.shared.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where the input has fewer partitions than there are cores (one small file); else leave them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
