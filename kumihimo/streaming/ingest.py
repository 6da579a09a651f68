"""Streams of landed records: labels appended once, and an index kept current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .index import MOST, add_batch

RECORDS = "id long, label string, source string, seen timestamp, lat double, lon double"
#: Bytes of a row group of the store: readers can share a file of long labels.
ROW_GROUP = 16 << 20


def key_of(label: str) -> Column:
    return F.trim(F.lower(label))


def digest_of(label: str) -> Column:
    """The key's SHA-256: what tells labels apart, however long they are."""
    return F.sha2(key_of(label), 256)


def ingest_new_labels(spark: SparkSession, incoming: str, store: str, checkpoint: str, late: str = "1 hour", schema: str = RECORDS) -> StreamingQuery:
    """Append each new label once to the store.

    Files of records arrive in ``incoming``. Repeats within the watermark are
    dropped by state; those of older records by an anti-join with the store. A
    batch that is run again after a failure writes nothing twice, as its own
    labels are in the store by then. Labels can be long texts: state, store and
    batch meet by the SHA-256 of the key, which is stored beside it.
    """
    stream = spark.readStream.schema(schema).json(incoming).where(key_of("label") != "").withColumn("digest", digest_of("label"))
    once = stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["digest"])

    def append(batch: DataFrame, _: int) -> None:
        known = _existing(spark, store)
        new = batch.dropDuplicates(["digest"])
        if known is not None:
            new = new.join(known.select("digest"), "digest", "left_anti")
        new.select(*batch.columns, key_of("label").alias("key")).write.mode("append").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(store)

    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_index(spark: SparkSession, store: str, index: str, checkpoint: str, buckets: int = 16, most: int = MOST, files: int | None = None, schema: str = RECORDS + ", key string") -> StreamingQuery:
    """Keep postings and grid current with rows appended to the store, by batches of ``files`` of its files (all that are new, if None)."""
    reader = spark.readStream.schema(schema)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(store).select("id", F.col("key").alias("label"), "lat", "lon")

    def add(batch: DataFrame, number: int) -> None:
        add_batch(spark, batch, index, number, buckets, most)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)
