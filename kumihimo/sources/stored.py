"""Derived tables kept in the shared folder, each under a name that its inputs' files decide."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset a local one, if Spark is local."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("kumihimo.shared.dir", None)
    if not at and conf.get("spark.master", "").startswith("local"):
        at = tempfile.mkdtemp(prefix="spark-kumihimo-")
        spark.conf.set("kumihimo.shared.dir", at)
    return at.rstrip("/") if at else None


def _at(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    name, files = _at(spark, path)
    return files.exists(name)


def remove(spark: SparkSession, path: str) -> None:
    name, files = _at(spark, path)
    files.delete(name, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename within a file system; False if the target is there."""
    name, files = _at(spark, path)
    target, _ = _at(spark, to)
    return not files.exists(target) and files.rename(name, target)


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the names, sizes and times of all files below some paths: another one whenever a file is written anew."""
    seen = hashlib.sha256()
    for path in sorted(paths):
        name, files = _at(spark, path)
        below = files.listFiles(name, True)
        rows = []
        while below.hasNext():
            f = below.next()
            rows.append(f"{f.getPath().toString()}\t{f.getLen()}\t{f.getModificationTime()}")
        seen.update("\n".join([path, *sorted(rows), ""]).encode())
    return seen.hexdigest()[:24]


def stored(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> str | None:
    """The folder of a derived table of the files in ``inputs``; made by ``write(path)`` if it is not there.

    It is written beside its place and then moved there, so a reader sees all
    of it or nothing, and sessions that share the folder share the table. None
    if executors share no folder.
    """
    base = shared_folder(spark)
    if base is None:
        return None
    path = f"{base}/kumihimo-{name}-{state_of(spark, inputs)}"
    if not exists(spark, path):
        fresh = f"{path}.{uuid.uuid4().hex}"
        write(fresh)
        if not move(spark, fresh, path):
            remove(spark, fresh)
    return path


def kept(spark: SparkSession, name: str, inputs: list[str]) -> str | None:
    """The folder of a derived table, if it has been made for this state of its inputs."""
    base = shared_folder(spark)
    path = base and f"{base}/kumihimo-{name}-{state_of(spark, inputs)}"
    return path if path and exists(spark, path) else None


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def materialized(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back, where they are read more than once and must be the same each time."""
    base = shared_folder(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path, schema = f"{base}/kept-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
