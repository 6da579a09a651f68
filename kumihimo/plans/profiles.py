"""Profiles of regions: all regions of a dictionary at once, each point joined with the boxes that hold it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..model import ASSETS, PREFECTURES, REGIONS, boxes, boxes_sql
from ..sources.graph import both_ways, first_per
from ..sources.stored import materialized, shared_folder
from .aggregates import micro, micro_sql, n_rows
from .registry import query

c = F.col


def in_boxes(points, dim, cell=0.5):
    """Points with each box that holds them. Boxes are cut to cells, so it is an equi-join; the dictionary has at most some hundred rows."""
    at = lambda x: F.floor(x / cell)
    span = lambda a, b: F.explode(F.sequence(at(c(a)), at(c(b))))
    cells = dim.withColumn("cy", span("lat_min", "lat_max")).withColumn("cx", span("lon_min", "lon_max"))
    p = points.withColumns({"cy": at(c("lat")), "cx": at(c("lon"))})
    inside = c("lat").between(c("lat_min"), c("lat_max")) & c("lon").between(c("lon_min"), c("lon_max"))
    return p.join(F.broadcast(cells), ["cy", "cx"]).where(inside).drop("cy", "cx", "lat_min", "lat_max", "lon_min", "lon_max")


def top_list(counts, name, n, order=None):
    """The first n of (code, v, k) of each code as 'v:k,...': by count, then value, or by another order."""
    few = first_per(counts, ["code"], order or [F.desc("k"), "v"]).where(c("rn") <= n)
    lists = few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "v", c("k").cast("string")).alias("t")))).alias("l"))
    return lists.select("code", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias(name))


def _top_sql(name, source, n, order="k DESC, v"):
    return f"{name} AS (SELECT code, string_agg(v || ':' || CAST(k AS VARCHAR), ',' ORDER BY rn) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {order}) AS rn FROM ({source}) q) z WHERE rn <= {n} GROUP BY code)"


def _tag_sql(axis):
    return f"SELECT code, value_code AS v, count(*) AS k FROM inb JOIN entity_tags t ON t.entity_id = inb.id AND t.axis = '{axis}' GROUP BY 1, 2"


def _profile_sql(places, kept):
    notable = "SELECT code, CAST(id AS VARCHAR) AS v, count(node) AS k FROM inb {} JOIN sym ON sym.node = inb.id {} GROUP BY 1, 2".format(*(("LEFT", "AND verdict = 'keep'") if kept else ("", "")))
    parts = [
        f"b AS {boxes_sql(places)}",
        "inb AS (SELECT code, id, entity_type, release_year FROM entities JOIN b ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max WHERE is_dormant = 0)",
        "deg AS (SELECT a_id AS id, count(*) AS k FROM connections GROUP BY 1), sp AS (SELECT DISTINCT node AS id FROM sym WHERE connection_type LIKE 'pilgrimage%')",
        "tagged AS (SELECT value_code AS code, count(DISTINCT entity_id) AS tagged FROM entity_tags WHERE axis = 'geography' GROUP BY 1)",
        "base AS (SELECT code, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS edges, count(sp.id) AS spots FROM inb LEFT JOIN deg ON deg.id = inb.id LEFT JOIN sp ON sp.id = inb.id GROUP BY code)",
        _top_sql("types", "SELECT code, entity_type AS v, count(*) AS k FROM inb GROUP BY 1, 2", 50),
        _top_sql("themes", _tag_sql("theme"), 15),
        _top_sql("eras", _tag_sql("era"), 10),
        _top_sql("notable", notable, 10),
    ]
    columns = "base.code, n, coalesce(tagged, 0) AS tagged, types, themes, eras, notable, spots"
    joins = "FROM base LEFT JOIN tagged USING (code) LEFT JOIN types USING (code) LEFT JOIN themes USING (code) LEFT JOIN eras USING (code) LEFT JOIN notable USING (code)"
    if kept:
        years = _top_sql("years", "SELECT code, CAST(release_year AS VARCHAR) AS v, count(*) AS k FROM inb WHERE release_year IS NOT NULL GROUP BY 1, 2", 20, "v DESC")
        return f"WITH {', '.join(parts)}, {years} SELECT {columns}, years {joins} LEFT JOIN years USING (code)"
    return f"WITH {', '.join(parts)} SELECT {columns}, edges, {micro_sql('edges / CAST(greatest(n, 1) AS DOUBLE)')} AS density6 {joins}"


def ends_of(edges, kept):
    """(id, k, n_ends, spot) of each node, by one pass over the edges: how often it is an a-end, how many edges (with ``kept``, kept ones) it has, and 1 if one of them is a pilgrimage."""
    counts = (~F.lit(kept) | (c("verdict") == "keep")).cast("int")
    marks = lambda node, first: edges.select(c(node).alias("id"), F.lit(first).alias("first"), counts.alias("counts"), F.when(c("connection_type").startswith("pilgrimage"), 1).alias("spot"))
    ends = marks("a_id", 1).unionByName(marks("b_id", 0))
    return ends.groupBy("id").agg(F.sum("first").alias("k"), F.sum("counts").alias("n_ends"), F.max("spot").alias("spot"))


def profile(g, places, kept=False):
    """Of each region: awake entities by type, top themes (15), eras (10) and nodes (10), pilgrimage places, entities tagged with the region.

    Regions count the edges of a-ends and take any edge of a node; with
    ``kept``, as prefectures have it, nodes count kept edges, none included,
    and the last twenty release years are listed.
    """
    points = g.entities.where("lat is not null and is_dormant = 0").select("id", "entity_type", "release_year", "lat", "lon").join(ends_of(g.edges, kept), "id", "left")
    # read for each part of the profile; edges once
    points = materialized(g.spark, points) if shared_folder(g.spark) else points
    at = in_boxes(points, boxes(g.spark, places)).drop("lat", "lon")
    base = at.groupBy("code").agg(n_rows(), F.coalesce(F.sum("k"), F.lit(0)).alias("edges"), F.count("spot").alias("spots"))
    named = g.tags.where("axis = 'geography'").join(F.broadcast(boxes(g.spark, places).select(c("code").alias("value_code"))), "value_code", "left_semi")
    tagged = named.groupBy(c("value_code").alias("code")).agg(F.count_distinct("entity_id").alias("tagged"))
    by_tag = lambda axis: at.select("id", "code").join(g.tags.where(c("axis") == axis).select(c("entity_id").alias("id"), c("value_code").alias("v")), "id").groupBy("code", "v").agg(F.count("*").alias("k"))
    nodes = (at if kept else at.where("n_ends > 0")).select("code", c("id").cast("string").alias("v"), F.coalesce("n_ends", F.lit(0)).alias("k"))
    lists = [
        top_list(at.groupBy("code", c("entity_type").alias("v")).agg(F.count("*").alias("k")), "types", 50),
        top_list(by_tag("theme"), "themes", 15),
        top_list(by_tag("era"), "eras", 10),
        top_list(nodes, "notable", 10),
    ]
    if kept:
        years = at.where("release_year is not null").groupBy("code", c("release_year").cast("string").alias("v")).agg(F.count("*").alias("k"))
        lists.append(top_list(years, "years", 20, [F.desc("v")]))
    out = base.join(F.broadcast(tagged), "code", "left").withColumn("tagged", F.coalesce("tagged", F.lit(0)))
    for part in lists:  # one row for each region of the dictionary
        out = out.join(part, "code", "left")
    return out.drop("edges") if kept else out.withColumn("density6", micro(c("edges") / F.greatest("n", F.lit(1))))


@query("q_region_profile", _profile_sql(REGIONS, False))
def q_region_profile(g):
    return profile(g, REGIONS)


@query("q_prefecture_profile", _profile_sql(PREFECTURES, True))
def q_prefecture_profile(g):
    return profile(g, PREFECTURES, kept=True)


@query("q_bulk_profiles", f"WITH b AS {boxes_sql(PREFECTURES)}, n AS (SELECT code, count(e.id) AS n FROM b LEFT JOIN entities e ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY code) SELECT code, n, rank() OVER (ORDER BY n DESC) AS place FROM n")
def q_bulk_profiles(g):
    """All 47 prefectures, empty ones too, ranked; boxes overlap, so a point may count in several."""
    dim = boxes(g.spark, PREFECTURES)
    per = in_boxes(g.entities.where("lat is not null").select("lat", "lon"), dim).groupBy("code").agg(n_rows())
    every = dim.select("code").join(per, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))
    return every.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))


_LOW, _HIGH, _GRID = (34.0, 135.0), (36.0, 137.0), 5


@query(
    "q_density_grid",
    f"""WITH p AS (SELECT CAST(least(4, greatest(0, floor((lat - 34.0) / 0.4))) AS BIGINT) AS row, CAST(least(4, greatest(0, floor((lon - 135.0) / 0.4))) AS BIGINT) AS col, entity_type FROM entities WHERE is_dormant = 0 AND lat BETWEEN 34.0 AND 36.0 AND lon BETWEEN 135.0 AND 137.0),
n AS (SELECT row, col, entity_type, count(*) AS n FROM p GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, entity_type) AS rn, sum(n) OVER (PARTITION BY row, col) AS total FROM n)
SELECT row, col, CAST(total AS BIGINT) AS n, entity_type AS dominant, row_number() OVER (ORDER BY total DESC, row, col) <= 10 AS hotspot, {micro_sql('sum(total) OVER () / 25.0')} AS mean6 FROM r WHERE rn = 1""",
)
def q_density_grid(g, low=_LOW, high=_HIGH, n=_GRID):
    """Cells of a box that hold awake entities: count, most frequent type, the ten fullest; the mean counts empty cells too."""
    cell = {"row": geo.density_cell(c("lat"), low[0], high[0], n), "col": geo.density_cell(c("lon"), low[1], high[1], n)}
    inside = g.entities.where("is_dormant = 0").where(c("lat").between(low[0], high[0]) & c("lon").between(low[1], high[1]))
    per = inside.groupBy(*[v.alias(k) for k, v in cell.items()], "entity_type").agg(n_rows())
    best = F.min(F.struct((-c("n")).alias("m"), "entity_type"))
    cells = per.groupBy("row", "col").agg(F.sum("n").alias("n"), best.alias("b"))  # n * n rows at most
    every = Window.orderBy(F.desc("n"), "row", "col")
    mean = micro(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / float(n * n))
    return cells.select("row", "col", "n", c("b.entity_type").alias("dominant"), (F.row_number().over(every) <= 10).alias("hotspot"), mean.alias("mean6"))


def _asset_sql(n):
    spot = "EXISTS (SELECT 1 FROM sym s WHERE s.node = e.id AND s.connection_type LIKE 'pilgrimage%')"
    test = lambda types, patterns: spot if types is None else f"(entity_type IN ({', '.join(map(repr, types))})" + (" AND (" + " OR ".join(f"label LIKE '{p}'" for p in patterns) + ")" if patterns else "") + ")"
    found = " UNION ALL ".join(f"SELECT '{k}' AS category, id, label, lat, lon FROM entities e WHERE is_dormant = 0 AND lat IS NOT NULL AND {test(types, patterns)}" for k, types, patterns in ASSETS)
    centres = ", ".join(f"('{k}', CAST({lat!r} AS DOUBLE), CAST({lon!r} AS DOUBLE))" for k, lat, lon, _ in REGIONS)
    away = "sqrt(pow((lat - clat) * 111.0, 2) + pow((lon - clon) * 111.0 * cos(radians(clat)), 2))"
    return f"""WITH b AS {boxes_sql(REGIONS)}, mid AS (SELECT * FROM (VALUES {centres}) v(code, clat, clon)), f AS ({found}),
h AS (SELECT b.code, category, id, {micro_sql(away)} AS km6, row_number() OVER (PARTITION BY b.code, category ORDER BY label, id) AS rn FROM f JOIN b ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max JOIN mid ON mid.code = b.code)
SELECT code, category, id, km6, row_number() OVER (PARTITION BY code, category ORDER BY km6, id) AS pos FROM h WHERE rn <= {n}"""


@query("q_tourism_assets", _asset_sql(20))
def q_tourism_assets(g, n=20):
    """Of each region (its own radius) and category of assets: the first n by label, ordered by distance from the centre."""
    spots = both_ways(g.edges.where(c("connection_type").startswith("pilgrimage"))).select(c("node").alias("id")).distinct().withColumn("spot", F.lit(True))
    e = g.entities.where("lat is not null and is_dormant = 0").select("id", "label", "entity_type", "lat", "lon").join(spots, "id", "left")
    names = []
    for name, types, patterns in ASSETS:
        fits = c("spot") if types is None else c("entity_type").isin(*types)
        if patterns:
            some = F.lit(False)
            for p in patterns:
                some = some | c("label").like(p)
            fits = fits & some
        names.append(F.when(fits, name))
    each = e.withColumn("category", F.explode(F.array_compact(F.array(*names))))
    centres = g.spark.createDataFrame([(k, lat, lon) for k, lat, lon, _ in REGIONS], "code string, clat double, clon double")
    at = in_boxes(each.withColumns({"y": c("lat"), "x": c("lon")}), boxes(g.spark, REGIONS)).join(F.broadcast(centres), "code")
    few = first_per(at, ["code", "category"], ["label", "id"]).where(c("rn") <= n).drop("rn")
    away = few.withColumn("km6", micro(geo.equirect_km(c("clat"), c("clon"), c("y"), c("x"))))
    return first_per(away, ["code", "category"], ["km6", "id"], "pos").select("code", "category", "id", "km6", c("pos").cast("long").alias("pos"))
