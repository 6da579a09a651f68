"""Window-shaped operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.graph import both_ways, first_per
from ..sources.stored import materialized
from .joins import NEAR_SQL
from .nearest import k_nearest, other_kind_first
from .registry import query

c = F.col

_BEST = "ORDER BY score DESC, other"


@query("win_topk_edges_per_node", f"SELECT node, other, rn FROM (SELECT node, other, row_number() OVER (PARTITION BY node {_BEST}) AS rn FROM sym WHERE verdict = 'keep') t WHERE rn <= 5")
def win_topk_edges_per_node(g, k=5):
    best = first_per(both_ways(g.kept), ["node"], [F.desc("score"), "other"])
    return best.where(c("rn") <= k).select("node", "other", c("rn").cast("long").alias("rn"))


@query("win_topk_per_category", f"SELECT node, connection_type, other, n FROM (SELECT node, connection_type, other, row_number() OVER (PARTITION BY node, connection_type {_BEST}) AS rn, count(*) OVER (PARTITION BY node, connection_type) AS n FROM sym) t WHERE rn = 1")
def win_topk_per_category(g):
    """The best edge of each kind, and how many there are: a grouped minimum, no sort."""
    best = F.min(F.struct((-c("score")).alias("s"), "other"))
    return g.both_ways.groupBy("node", "connection_type").agg(best.alias("b"), F.count("*").alias("n")).select("node", "connection_type", "b.other", "n")


@query("win_cap_locations", "SELECT node AS work, count(*) AS n, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS places FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other) AS rn FROM sym WHERE connection_type = 'pilgrimage_spot' AND node >= 3000000000000) t WHERE rn <= 5 GROUP BY node")
def win_cap_locations(g, cap=5):
    """At most ``cap`` places of each work; the count is made after the cap."""
    spots = both_ways(g.edges.where("connection_type = 'pilgrimage_spot'")).where("node >= 3000000000000")
    few = first_per(spots, ["node"], ["other"]).where(c("rn") <= cap)
    places = F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ",")
    return few.groupBy(c("node").alias("work")).agg(F.count("*").alias("n"), places.alias("places"))


_ROW = (1 << 33) - 1


def ranged(df, group, order):
    """Rows dealt out by ranges of (group, order) and sorted, with their partition (pid) and place in it (at): a large group lies in many partitions, next to each other."""
    at = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id())
    return at.withColumn("pid", F.shiftright("at", 33)).withColumn("at", c("at").bitwiseAND(F.lit(_ROW)))


def linked_to_next(df, group, order, k=1, keep=(), both=()):
    """Pairs of each member with the next k of its group: (x, y, step). ``order`` ends in what no two members share. ``keep`` names columns of x to keep, ``both`` columns of x and y, kept as xn, yn.

    Members are linked inside ranges of (group, order), so a group that holds
    most rows is many tasks' work. The first k rows of a range are also lent
    to the k ranges before it, where its group may end.
    """
    rows = ranged(df.select(*dict.fromkeys([*group, *order, "id", *keep, *both])), group, order)
    lent = F.when(c("at") < k, F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: c("pid") - j)).otherwise(F.array("pid"))
    lent_to = rows.withColumn("to", F.explode(lent))
    w = Window.partitionBy("to", *group).orderBy(*order)
    nexts = F.array(*[F.lead(F.struct("id", *both), i).over(w) for i in range(1, k + 1)])
    own = lent_to.select("*", nexts.alias("nexts")).where("to = pid")
    pairs = own.select(*group, c("id").alias("x"), *keep, *[c(n).alias(f"x{n}") for n in both], F.posexplode("nexts").alias("step", "next")).where("next is not null")
    return pairs.select(*[x for x in pairs.columns if x != "next"], c("next.id").alias("y"), *[c(f"next.{n}").alias(f"y{n}") for n in both])


def numbered(g, df, group, order):
    """Adds i, a member's place in its group from 0, and n, the group's size: places inside ranges, and the sizes of the ranges before."""
    rows = materialized(g.spark, ranged(df, group, order))
    parts = rows.groupBy(*group, "pid").agg(F.count("*").alias("held"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("held").over(whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "pid", before.alias("before"), F.sum("held").over(whole).alias("n"))
    here = F.row_number().over(Window.partitionBy(*group, "pid").orderBy("at")) - 1
    return rows.withColumn("here", here).join(parts, [*group, "pid"]).withColumn("i", c("here") + c("before")).drop("here", "before", "pid", "at")


@query("win_chain_adjacent", "SELECT x, y FROM (SELECT id AS x, lead(id) OVER (PARTITION BY source ORDER BY id) AS y FROM entities) t WHERE y IS NOT NULL")
def win_chain_adjacent(g):
    return linked_to_next(g.entities.select("id", "source"), ["source"], ["id"]).select("x", "y")


@query(
    "win_next_k_neighbors",
    "WITH r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY label, id) AS rn FROM entities) SELECT a.id AS x, b.id AS y, b.rn - a.rn AS step FROM r a JOIN r b ON a.source = b.source AND b.rn BETWEEN a.rn + 1 AND a.rn + 3",
)
def win_next_k_neighbors(g, k=3):
    return linked_to_next(g.entities.select("id", "source", "label"), ["source"], ["label", "id"], k).select("x", "y", (c("step") + 1).cast("long").alias("step"))


def capped_pairs(df, group, order, cap):
    """All pairs among the first ``cap`` members of each group: (x, y), x first in order."""
    few = first_per(df, group, order).where(c("rn") <= cap)
    a = few.select(*group, c("id").alias("x"), c("rn").alias("rx"))
    b = few.select(*group, c("id").alias("y"), c("rn").alias("ry"))
    return a.join(b, group).where("rx < ry").drop("rx", "ry")


@query(
    "win_all_pairs_capped",
    "WITH r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM entities) SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON a.source = b.source AND a.rn < b.rn AND b.rn <= 20",
)
def win_all_pairs_capped(g, cap=20):
    """The cap stands before the join: it is the operator's limit on a group's pairs."""
    return capped_pairs(g.entities.select("id", "source"), ["source"], ["id"], cap).select("x", "y")


@query(
    "win_nearest_k",
    f"WITH {NEAR_SQL} SELECT a_id, b_id, rn FROM (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY CASE WHEN a_type <> b_type THEN 1 ELSE 0 END DESC, floor(metres + 0.5), b_id) AS rn FROM near WHERE metres <= 1000) t WHERE rn <= 3",
)
def win_nearest_k(g, k=3, radius=1000.0):
    """The k nearest of each place: other type first, then distance to the metre, then id."""
    points = g.entities.select("id", "lat", "lon", "entity_type")
    best = other_kind_first(k_nearest(points, points, radius, k, kind="entity_type"), points.select("id", "entity_type"), k)
    return best.select("a_id", "b_id", c("rn").cast("long").alias("rn"))


def year_spine(df, low, high):
    """Every year between two columns of a one-row frame."""
    return df.select(F.explode(F.sequence(c(low), c(high))).alias("year"))


@query(
    "win_new_and_cumulative",
    """WITH f AS (SELECT s.node, min(e.release_year) AS year FROM sym s JOIN entities e ON e.id = s.other WHERE s.connection_type = 'pilgrimage_spot' AND e.release_year IS NOT NULL GROUP BY s.node),
w AS (SELECT DISTINCT e.id, e.release_year AS year FROM sym s JOIN entities e ON e.id = s.node WHERE s.connection_type = 'pilgrimage_spot' AND e.release_year IS NOT NULL),
b AS (SELECT min(year) AS lo, max(year) AS hi FROM (SELECT year FROM f UNION ALL SELECT year FROM w) u),
spine AS (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS year FROM b),
n AS (SELECT s.year, (SELECT count(*) FROM w WHERE w.year = s.year) AS works, (SELECT count(*) FROM f WHERE f.year = s.year) AS places FROM spine s)
SELECT CAST(year AS INT) AS year, works, places, CAST(sum(works) OVER (ORDER BY year) AS BIGINT) AS all_works, CAST(sum(places) OVER (ORDER BY year) AS BIGINT) AS all_places FROM n""",
)
def win_new_and_cumulative(g):
    """Works and places new in each year, and so far; years without any count 0. One row for each year, so the running sum is over a small frame."""
    spots = both_ways(g.edges.where("connection_type = 'pilgrimage_spot'")).select("node", "other")
    years = g.entities.where("release_year is not null").select("id", "release_year")
    works = spots.join(years, c("node") == c("id")).select("id", c("release_year").alias("year")).distinct()
    places = spots.join(years, c("other") == c("id")).groupBy("node").agg(F.min("release_year").alias("year"))
    per = works.groupBy("year").agg(F.count("*").alias("works")).join(places.groupBy("year").agg(F.count("*").alias("places")), "year", "full")
    spine = year_spine(per.agg(F.min("year").alias("lo"), F.max("year").alias("hi")), "lo", "hi")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    filled = spine.join(per, "year", "left").select("year", zero("works"), zero("places"))
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("year", "works", "places", F.sum("works").over(upto).alias("all_works"), F.sum("places").over(upto).alias("all_places"))


@query(
    "win_group_quota",
    "SELECT a_id, b_id FROM (SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id) AS rb FROM connections WHERE verdict = 'keep') t WHERE ra <= 15 AND rb <= 15 ORDER BY score DESC, a_id, b_id LIMIT 800",
)
def win_group_quota(g, quota=15, total=800):
    """An edge needs a place within the quota of both its ends, then of the total."""
    ranked = first_per(first_per(g.kept, ["a_id"], [F.desc("score"), "b_id"], "ra"), ["b_id"], [F.desc("score"), "a_id"], "rb")
    return ranked.where((c("ra") <= quota) & (c("rb") <= quota)).orderBy(F.desc("score"), "a_id", "b_id").limit(total).select("a_id", "b_id")


def hash_order(seed, column="id"):
    """A deterministic shuffle."""
    return F.md5(F.concat(F.lit(seed), c(column).cast("string")).cast("binary"))


@query("win_sample_group", "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5('g' || CAST(id AS VARCHAR)), id) AS rn FROM entities) t WHERE rn <= 10")
def win_sample_group(g, n=10, seed="g"):
    return first_per(g.entities.select("id", "source"), ["source"], [hash_order(seed), "id"]).where(c("rn") <= n).select("id", "source")


@query(
    "win_grid_layout",
    """SELECT id, CAST(i % side AS BIGINT) AS col, CAST(floor(i / CAST(side AS DOUBLE)) AS BIGINT) AS row FROM (
SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS i, CAST(ceil(sqrt(count(*) OVER (PARTITION BY source))) AS BIGINT) AS side FROM entities WHERE lat IS NULL) t""",
)
def win_grid_layout(g):
    """The cell of each member on a square grid around its group's centre."""
    free = g.entities.where("lat is null").select("id", "source")
    at = numbered(g, free, ["source"], ["id"]).withColumn("side", F.ceil(F.sqrt("n")))
    return at.select("id", (c("i") % c("side")).cast("long").alias("col"), F.floor(c("i") / c("side")).alias("row"))
