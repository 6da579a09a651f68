"""The graph's three tables, bound to the star-schema tables of a folder."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import read, stored

#: Rows of edges, before the first of each pair is taken, for a task; and for one where there are fewer tasks than cores.
TASK_ROWS, LEAST_ROWS = 2_500_000, 100_000
EDGES = "a_id long, b_id long, connection_type string, score double, verdict string, source string"


def _entity(df: DataFrame, base: int, key: str, label: str, kind: str, source: Column, geo: Column, label_en: Column | None = None, year: Column | None = None, qid: Column | None = None, dormant: Column | None = None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    number = (F.lit(base) + F.col(key)).cast("long")
    place = lambda origin, step: F.when(geo, F.lit(float(origin)) + ((number * step) % 2000).cast("double") / 1000.0)
    return df.select(
        number.alias("id"),
        F.expr(label).alias("label"),
        (label_en if label_en is not None else null("string")).alias("label_en"),
        F.lit(kind).alias("entity_type"),
        source.alias("source"),
        (year if year is not None else null("int")).cast("int").alias("release_year"),
        (qid if qid is not None else null("string")).alias("qid"),
        (dormant if dormant is not None else F.lit(0)).alias("is_dormant"),
        place(34, 7919).alias("lat"),
        place(135, 104729).alias("lon"),
    )


class Graph:
    """entities, tags and edges over the tables of one folder. Each is lazy and column-pruned by what a query uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """id, label, label_en, entity_type, source, release_year, qid, is_dormant, lat, lon."""
        c = F.col
        people = _entity(self.table("customer"), 1_000_000_000_000, "c_custkey", "c_name", "person", c("c_mktsegment"), c("c_custkey") % 2 == 0, qid=F.concat(F.lit("Q"), c("c_custkey").cast("string")))
        places = _entity(self.table("supplier"), 2_000_000_000_000, "s_suppkey", "s_name", "place", F.lit("supplier"), F.lit(True), label_en=F.lower("s_name"))
        works = _entity(self.table("part"), 3_000_000_000_000, "p_partkey", "p_name", "work", c("p_brand"), c("p_partkey") % 3 == 0, label_en=F.upper("p_name"), year=1600 + (c("p_partkey") * 37) % 425)
        artifacts = _entity(self.table("documents"), 4_000_000_000_000, "doc_id", "text", "artifact", c("source"), c("doc_id") % 2 == 1, dormant=F.when(c("doc_id") % 10 == 9, 1).otherwise(0))
        return people.unionByName(places).unionByName(works).unionByName(artifacts)

    @cached_property
    def tags(self) -> DataFrame:
        """entity_id, axis, value_code, confidence."""
        from ..model import era_of

        region = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

        def tag(df: DataFrame, base: int, key: str, axis: str, value, confidence: float) -> DataFrame:
            return df.select((F.lit(base) + F.col(key)).cast("long").alias("entity_id"), F.lit(axis).alias("axis"), value.alias("value_code"), F.lit(confidence).alias("confidence"))

        part, customer, supplier = self.table("part"), self.table("customer"), self.table("supplier")
        year = part.withColumn("y", (1600 + (F.col("p_partkey") * 37) % 425))
        parts = [
            tag(part, 3_000_000_000_000, "p_partkey", "theme", F.col("p_type"), 1.0),
            tag(part, 3_000_000_000_000, "p_partkey", "medium", F.col("p_brand"), 1.0),
            tag(year, 3_000_000_000_000, "p_partkey", "era", F.expr(era_of("y")), 0.9),
            tag(supplier.join(region, F.col("s_nationkey") == F.col("n_nationkey")), 2_000_000_000_000, "s_suppkey", "geography", F.col("r_name"), 0.8),
            tag(customer.join(region, F.col("c_nationkey") == F.col("n_nationkey")), 1_000_000_000_000, "c_custkey", "geography", F.col("r_name"), 0.8),
            tag(customer, 1_000_000_000_000, "c_custkey", "experience", F.col("c_mktsegment"), 0.7),
            tag(self.table("documents"), 4_000_000_000_000, "doc_id", "medium", F.col("lang"), 0.6),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def edges(self) -> DataFrame:
        """a_id < b_id, connection_type, score, verdict, source; one row for each pair. Written once to the shared folder for a state of the tables' files, and read from there; without such a folder, made by each query."""
        inputs = [f"{self.folder}/{t}.parquet" for t in ("lineitem", "orders")]
        path = stored(self.spark, "edges", inputs, lambda at: self.made_edges().sortWithinPartitions("a_id", "b_id").write.parquet(at))
        return self.made_edges() if path is None else read(self.spark, path, EDGES)

    def made_edges(self) -> DataFrame:
        """The edges as a plan over the tables. Few pairs repeat, so rows are dealt before they are sorted, narrow, to as many tasks as hold them in a bounded share."""
        line, orders = self.table("lineitem"), self.table("orders")
        c = F.col

        def rows(df: DataFrame, a: Column, score: str, reject: Column, kind: Column) -> DataFrame:
            # verdict and type as one number, ordered as they are: keep, reject; creator_work, pilgrimage_spot, same_source
            code = (F.when(reject, 4).otherwise(0) + kind).cast("byte")
            return df.select(a.cast("long").alias("a_id"), (3_000_000_000_000 + c("l_partkey")).cast("long").alias("b_id"), c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), (c(score) * 10).cast("double").alias("score"), code.alias("code"))

        supply = rows(line, 2_000_000_000_000 + c("l_suppkey"), "l_discount", c("l_returnflag") == "R", F.when(c("l_linestatus") == "O", 1).otherwise(2))
        made = rows(orders.join(line, c("o_orderkey") == c("l_orderkey")), 1_000_000_000_000 + c("o_custkey"), "l_tax", c("o_orderstatus") == "F", F.lit(0))
        dealt = supply.unionByName(made).repartition(edge_tasks(2 * line.count(), self.spark.sparkContext.defaultParallelism), "a_id", "b_id")
        first = dealt.groupBy("a_id", "b_id").agg(F.min(F.struct("k1", "k2", "score", "code")).alias("f")).select("a_id", "b_id", "f.score", "f.code")
        kind = c("code") % 4
        return first.select(
            "a_id",
            "b_id",
            F.when(kind == 0, "creator_work").when(kind == 1, "pilgrimage_spot").otherwise("same_source").alias("connection_type"),
            "score",
            F.when(c("code") >= 4, "reject").otherwise("keep").alias("verdict"),
            F.when(kind == 0, "orders").otherwise("lineitem").alias("source"),
        )

    @cached_property
    def kept(self) -> DataFrame:
        return self.edges.where("verdict = 'keep'")

    @cached_property
    def both_ways(self) -> DataFrame:
        """Each edge from both ends: node, other and the edge's columns."""
        return both_ways(self.edges)


def edge_tasks(rows: int, cores: int) -> int:
    """Tasks for so many rows of edges."""
    return max(1, math.ceil(rows / TASK_ROWS), min(cores, math.ceil(rows / LEAST_ROWS)))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, so that a condition on either end is one equi-join."""
    rest = [c for c in edges.columns if c not in ("a_id", "b_id")]
    return edges.select(F.col("a_id").alias("node"), F.col("b_id").alias("other"), *rest).unionByName(edges.select(F.col("b_id").alias("node"), F.col("a_id").alias("other"), *rest))


def nodes_of(edges: DataFrame) -> DataFrame:
    """The ends of edges, each once: what a semi or anti join needs of them. Counted out in each task first, so edges are not shuffled."""
    ends = edges.select(F.col("a_id").alias("node")).distinct().unionByName(edges.select(F.col("b_id").alias("node")).distinct())
    return ends.distinct()


def first_per(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """Adds the row number within ``keys`` by a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: The same views in DuckDB's SQL, put before each oracle.
VIEWS_SQL = """entities AS (
  SELECT id, label, label_en, entity_type, source, release_year, qid, is_dormant,
         CASE WHEN geo THEN CAST(34.0 AS DOUBLE) + CAST((id * 7919) % 2000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) END AS lat,
         CASE WHEN geo THEN CAST(135.0 AS DOUBLE) + CAST((id * 104729) % 2000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) END AS lon
  FROM (
    SELECT CAST(1000000000000 + c_custkey AS BIGINT) AS id, c_name AS label, CAST(NULL AS VARCHAR) AS label_en,
           'person' AS entity_type, c_mktsegment AS source, CAST(NULL AS INT) AS release_year,
           concat('Q', CAST(c_custkey AS VARCHAR)) AS qid, 0 AS is_dormant, c_custkey % 2 = 0 AS geo FROM customer
    UNION ALL
    SELECT CAST(2000000000000 + s_suppkey AS BIGINT), s_name, lower(s_name), 'place', 'supplier', CAST(NULL AS INT),
           CAST(NULL AS VARCHAR), 0, TRUE FROM supplier
    UNION ALL
    SELECT CAST(3000000000000 + p_partkey AS BIGINT), p_name, upper(p_name), 'work', p_brand,
           CAST(1600 + (p_partkey * 37) % 425 AS INT), CAST(NULL AS VARCHAR), 0, p_partkey % 3 = 0 FROM part
    UNION ALL
    SELECT CAST(4000000000000 + doc_id AS BIGINT), text, CAST(NULL AS VARCHAR), 'artifact', source,
           CAST(NULL AS INT), CAST(NULL AS VARCHAR), CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END, doc_id % 2 = 1 FROM documents) t),
entity_tags AS (
  SELECT CAST(3000000000000 + p_partkey AS BIGINT) AS entity_id, 'theme' AS axis, p_type AS value_code, CAST(1.0 AS DOUBLE) AS confidence FROM part
  UNION ALL SELECT 3000000000000 + p_partkey, 'medium', p_brand, 1.0 FROM part
  UNION ALL SELECT 3000000000000 + p_partkey, 'era',
    CASE WHEN y < 1700 THEN 'edo_early' WHEN y < 1868 THEN 'edo_late' WHEN y < 1926 THEN 'meiji_taisho'
         WHEN y < 1945 THEN 'showa_prewar' WHEN y < 1989 THEN 'showa_postwar' WHEN y < 2019 THEN 'heisei' ELSE 'reiwa' END, 0.9
    FROM (SELECT p_partkey, 1600 + (p_partkey * 37) % 425 AS y FROM part) q
  UNION ALL SELECT 2000000000000 + s_suppkey, 'geography', r_name, 0.8
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000000000 + c_custkey, 'geography', r_name, 0.8
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000000000 + c_custkey, 'experience', c_mktsegment, 0.7 FROM customer
  UNION ALL SELECT 4000000000000 + doc_id, 'medium', lang, 0.6 FROM documents),
connections AS (
  SELECT a_id, b_id, connection_type, score, verdict, source FROM (
    SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY k1, k2, score, verdict, connection_type) AS rn FROM (
      SELECT CAST(2000000000000 + l_suppkey AS BIGINT) AS a_id, CAST(3000000000000 + l_partkey AS BIGINT) AS b_id,
             CASE WHEN l_linestatus = 'O' THEN 'pilgrimage_spot' ELSE 'same_source' END AS connection_type,
             CAST(l_discount * 10 AS DOUBLE) AS score, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'keep' END AS verdict,
             'lineitem' AS source, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem
      UNION ALL
      SELECT 1000000000000 + o_custkey, 3000000000000 + l_partkey, 'creator_work', CAST(l_tax * 10 AS DOUBLE),
             CASE WHEN o_orderstatus = 'F' THEN 'reject' ELSE 'keep' END, 'orders', l_orderkey, l_linenumber
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey) u) w
  WHERE rn = 1),
sym AS (
  SELECT a_id AS node, b_id AS other, connection_type, score, verdict, source FROM connections
  UNION ALL SELECT b_id, a_id, connection_type, score, verdict, source FROM connections)"""
