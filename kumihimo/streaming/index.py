"""An index that a stream keeps current: postings and a grid of places in versions of buckets, and a manifest that names the live ones.

    index/manifest/000000000007/     (kind, bucket, versions) after batch 7
    index/postings/v=7/bucket=3/     what batch 7 added to bucket 3
    index/postings/v=7c/bucket=3/    bucket 3 whole, written anew by batch 7

A batch writes its rows beside the others, and buckets that it touched and
that have more than ``most`` versions are written whole; then the manifest of
the batch is written, which makes them visible at once. Everything that a
batch writes is named by its number and follows from the manifest before, so a
batch that runs again replaces its own work and changes nothing. Versions that
neither of the last two manifests names are removed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.text_index import PACKED, bucket_of, packed_grams, unpacked
from ..sources.stored import _at, exists, remove

c = F.col

#: Columns of the files: postings that share a token are one row of arrays for each slice of texts.
SCHEMAS = {"postings": PACKED, "grid": "cy long, cx long, id long, lat double, lon double"}
#: Degrees of a cell of the grid.
CELL = 0.25
MOST = 4


def _manifests(spark: SparkSession, index: str) -> list[int]:
    """Numbers of the finished manifests."""
    if not exists(spark, f"{index}/manifest"):
        return []
    name, files = _at(spark, f"{index}/manifest")
    found = [s.getPath().getName() for s in files.listStatus(name)]
    return sorted(int(n) for n in found if n.isdigit() and exists(spark, f"{index}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, index: str, before: int | None = None) -> dict[tuple[str, int], list[str]]:
    """Live versions of each (kind, bucket), by the last manifest or the last below a batch. As many entries as there are buckets."""
    known = [n for n in _manifests(spark, index) if before is None or n < before]
    if not known:
        return {}
    rows = spark.read.schema("kind string, bucket int, versions array<string>").json(f"{index}/manifest/{known[-1]:012d}").collect()
    return {(r["kind"], r["bucket"]): list(r["versions"]) for r in rows}


def _paths(index: str, live: dict[tuple[str, int], list[str]], kind: str, buckets: list[int] | None) -> list[str]:
    return [f"{index}/{kind}/v={v}/bucket={b}" for (k, b), vs in sorted(live.items()) if k == kind and (buckets is None or b in buckets) for v in vs]


def _stored(spark: SparkSession, index: str, kind: str, buckets: list[int] | None = None) -> DataFrame:
    """The live rows of some buckets, or of all, as they are in the files."""
    paths = _paths(index, manifest(spark, index), kind, buckets)
    return spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[kind])


def read_index(spark: SparkSession, index: str, kind: str, buckets: list[int] | None = None) -> DataFrame:
    """The live rows of some buckets, or of all; postings are (token, id, field, positions, length)."""
    rows = _stored(spark, index, kind, buckets)
    return unpacked(rows) if kind == "postings" else rows


def labels_of_tokens(spark: SparkSession, index: str) -> DataFrame:
    """(token, n): in how many labels each token stands, from the lists of ids alone."""
    return _stored(spark, index, "postings").groupBy("token").agg(F.sum(F.size("ids").cast("long")).alias("n"))


def cell_bucket(cy: Column, cx: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(cy, cx), F.lit(buckets)).cast("int")


def in_box(spark: SparkSession, index: str, south: float, west: float, north: float, east: float, buckets: int) -> DataFrame:
    """(id, lat, lon) in a box; reads the buckets of the box's cells, all of them where it has more cells than there are buckets."""
    rows, columns = (range(math.floor(a / CELL), math.floor(b / CELL) + 1) for a, b in ((south, north), (west, east)))
    wanted = None
    if 0 < len(rows) * len(columns) <= 16 * buckets:
        cells = F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(x).cast("long").alias("x")) for y in rows for x in columns])
        wanted = spark.sql("SELECT 1").select(F.array_distinct(F.transform(cells, lambda k: cell_bucket(k["y"], k["x"], buckets))).alias("b")).first()["b"]
    found = read_index(spark, index, "grid", wanted).where(c("cy").between(min(rows, default=0), max(rows, default=-1)) & c("cx").between(min(columns, default=0), max(columns, default=-1)))
    return found.where(c("lat").between(south, north) & c("lon").between(west, east)).select("id", "lat", "lon")


def with_token(spark: SparkSession, index: str, token: str, buckets: int) -> DataFrame:
    """A token's postings, from its bucket."""
    bucket = spark.sql("SELECT 1").select(bucket_of(F.lit(token), buckets).alias("b")).first()["b"]
    return unpacked(_stored(spark, index, "postings", [bucket]).where(c("token") == token))


def _write(rows: DataFrame, path: str, gather: bool = True) -> None:
    """A file for each bucket, or some of even size where one is large; where rows are not gathered, one for each bucket of each task, and nothing is shuffled."""
    placed = rows.hint("rebalance", "bucket") if gather else rows
    placed.sortWithinPartitions("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def add_batch(spark: SparkSession, records: DataFrame, index: str, number: int, buckets: int = 16, most: int = MOST) -> None:
    """Records (id, label, and lat, lon where they have a place) into postings and grid, as batch ``number``."""
    cells = lambda x: F.floor(c(x) / CELL)
    words = packed_grams(records.select("id", "label"))
    grid = records.where("lat is not null and lon is not null").select(cells("lat").alias("cy"), cells("lon").alias("cx"), "id", "lat", "lon")
    parts = {"postings": words.withColumn("bucket", bucket_of(c("token"), buckets)), "grid": grid.withColumn("bucket", cell_bucket(c("cy"), c("cx"), buckets))}
    live = manifest(spark, index, before=number)
    for kind, rows in parts.items():
        # postings are several times the texts: they stay in the task that cut them until a bucket is written whole
        _write(rows, f"{index}/{kind}/v={number}", gather=kind != "postings")
        folder, files = _at(spark, f"{index}/{kind}/v={number}")
        touched = sorted(int(n.split("=")[1]) for n in (s.getPath().getName() for s in files.listStatus(folder)) if n.startswith("bucket="))
        for b in touched:
            live.setdefault((kind, b), []).append(str(number))
        full = [b for b in touched if len(live[kind, b]) > most]
        if full:
            # each bucket from its own folders, so that its number need not be read from a row
            whole = [spark.read.schema(SCHEMAS[kind]).parquet(*_paths(index, live, kind, [b])).withColumn("bucket", F.lit(b)) for b in full]
            _write(reduce(DataFrame.unionByName, whole), f"{index}/{kind}/v={number}c")
            for b in full:
                live[kind, b] = [f"{number}c"]
    rows = spark.createDataFrame([(k, b, vs) for (k, b), vs in sorted(live.items())], "kind string, bucket int, versions array<string>")
    rows.coalesce(1).write.mode("overwrite").json(f"{index}/manifest/{number:012d}")
    _clean(spark, index, live, manifest(spark, index, before=number))


def _clean(spark: SparkSession, index: str, *lives: dict[tuple[str, int], list[str]]) -> None:
    """Remove buckets of versions that no given manifest names, and manifests but the last two."""
    named = {(k, b, v) for live in lives for (k, b), vs in live.items() for v in vs}
    for kind in SCHEMAS:
        top, files = _at(spark, f"{index}/{kind}")
        for version in files.listStatus(top):
            v = version.getPath().getName().removeprefix("v=")
            below = [s.getPath() for s in files.listStatus(version.getPath()) if s.getPath().getName().startswith("bucket=")]
            dead = [p for p in below if (kind, int(p.getName().split("=")[1]), v) not in named]
            for p in dead:
                files.delete(p, True)
            if len(dead) == len(below):
                files.delete(version.getPath(), True)
    for n in _manifests(spark, index)[:-2]:
        remove(spark, f"{index}/manifest/{n:012d}")
