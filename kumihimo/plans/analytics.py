"""Analytic queries, in batch form: all regions, start nodes or keywords at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.routes import routes_in_order
from ..model import CALENDAR, MONTH_WORDS, NEIGHBOUR_KINDS, SEASON_WORDS, era_midpoint
from ..sources.graph import both_ways, first_per
from .aggregates import micro, micro_sql, n_rows
from .registry import query
from ..sources.files import write_datasets
from ..sources.stored import materialized
from .search import search
from .selections import degree_box
from .windows import hash_order

c = F.col


def with_tags(g, df, key="id", name="tags"):
    """Adds an entity's tags as 'axis=value,...'."""
    one = g.tags.groupBy(c("entity_id").alias(key)).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "axis", "value_code"))), ",").alias(name))
    return df.join(one, key, "left")


_TAGS = "tm AS (SELECT entity_id, string_agg(DISTINCT axis || '=' || value_code, ',' ORDER BY axis || '=' || value_code) AS tags FROM entity_tags GROUP BY entity_id)"


# ---- search-led


@query("q_axis_values", "SELECT axis, value_code, count(DISTINCT entity_id) AS n FROM entity_tags GROUP BY axis, value_code")
def q_axis_values(g):
    return g.tags.groupBy("axis", "value_code").agg(F.count_distinct("entity_id").alias("n"))


@query("q_axis_entities", "SELECT t.entity_id, e.label FROM entity_tags t JOIN entities e ON e.id = t.entity_id WHERE axis = 'era' AND value_code = 'heisei' ORDER BY confidence DESC, entity_id LIMIT 100")
def q_axis_entities(g, axis="era", value="heisei", n=100):
    few = g.tags.where((c("axis") == axis) & (c("value_code") == value)).orderBy(F.desc("confidence"), "entity_id").limit(n)
    return few.join(g.entities.select("id", "label"), c("entity_id") == c("id")).select("entity_id", "label")


@query(
    "q_serendipity",
    f"""WITH {_TAGS}, h AS (SELECT id FROM entities WHERE contains(lower(label), 'red') ORDER BY id LIMIT 50), d AS (SELECT h.id, count(s.other) AS k FROM h LEFT JOIN sym s ON s.node = h.id GROUP BY h.id), t AS (SELECT id FROM d ORDER BY k DESC, id LIMIT 1),
e AS (SELECT s.*, CASE WHEN s.verdict = 'keep' THEN 0 ELSE 1 END AS tier FROM sym s JOIN t ON t.id = s.node WHERE s.score >= 0.3),
b AS (SELECT * FROM e WHERE tier = (SELECT min(tier) FROM e) ORDER BY CASE WHEN source = 'orders' THEN 0 ELSE 1 END, score DESC, other LIMIT 10)
SELECT b.node, b.other, b.connection_type, x.tags AS node_tags, y.tags AS other_tags FROM b LEFT JOIN tm x ON x.entity_id = b.node LEFT JOIN tm y ON y.entity_id = b.other""",
)
def q_serendipity(g, keyword="red", at=0.3, n=10):
    """The most connected of the hits, and its best kept edges, with both ends' tags; edges of any verdict where none is kept."""
    hits = search(g, keyword).orderBy("id").limit(50).select("id")
    degree = hits.join(g.both_ways.select("node", "other"), c("id") == c("node"), "left").groupBy("id").agg(F.count("other").alias("k"))
    top = degree.orderBy(F.desc("k"), "id").limit(1).select("id")
    edges = both_ways(g.edges.where(c("score") >= at)).join(F.broadcast(top), c("node") == c("id"), "left_semi")
    best = edges.withColumn("tier", F.when(c("verdict") == "keep", 0).otherwise(1)).orderBy("tier", F.when(c("source") == "orders", 0).otherwise(1), F.desc("score"), "other").limit(n)
    few = best.withColumn("least", F.min("tier").over(Window.partitionBy("node"))).where("tier = least").select("node", "other", "connection_type")
    return with_tags(g, with_tags(g, few, "node", "node_tags"), "other", "other_tags")


@query(
    "q_entity_detail",
    f"WITH {_TAGS}, f AS (SELECT min(id) AS id FROM entities WHERE label ILIKE '%bolt%') SELECT f.id, e.label, tm.tags, s.other, s.connection_type FROM f JOIN entities e ON e.id = f.id JOIN sym s ON s.node = f.id LEFT JOIN tm ON tm.entity_id = f.id WHERE s.verdict = 'keep' ORDER BY s.score DESC, s.other LIMIT 20",
)
def q_entity_detail(g, keyword="bolt", n=20):
    """The first hit with its tags and best kept edges."""
    first = search(g, keyword).agg(F.min_by("label", "id").alias("label"), F.min("id").alias("id"))
    edges = both_ways(g.kept).join(F.broadcast(first), c("node") == c("id")).orderBy(F.desc("score"), "other").limit(n)
    return with_tags(g, edges.select("id", "label", "other", "connection_type"))


@query(
    "q_search_culture",
    "WITH h AS (SELECT * FROM entities WHERE contains(lower(label), 'blue')), a AS (SELECT count(*) AS n, bool_or(entity_type = 'work') AS has_work, bool_or(lat IS NOT NULL) AS has_place, bool_or(release_year IS NOT NULL) AS has_year FROM h) SELECT id, label, entity_type, n, has_work, has_place, has_year FROM (SELECT * FROM h ORDER BY id LIMIT 20) t, a",
)
def q_search_culture(g, keyword="blue", n=20):
    """The first hits, and what all of them offer to ask next."""
    hits = search(g, keyword).select("id", "label", "entity_type", "lat", "release_year")
    offers = hits.agg(n_rows(), F.bool_or(c("entity_type") == "work").alias("has_work"), F.bool_or(c("lat").isNotNull()).alias("has_place"), F.bool_or(c("release_year").isNotNull()).alias("has_year"))
    one = F.lit(1).alias("one")
    return hits.orderBy("id").limit(n).select("id", "label", "entity_type", one).join(F.broadcast(offers.select("*", one)), "one").drop("one")


def filtered(g, keyword=None, kind=None, axis=None, value=None):
    """A filtered search with any of its conditions."""
    conditions = [c("label").ilike(f"%{keyword}%")] if keyword else []
    if kind:
        conditions.append(c("entity_type") == kind)
    out = g.entities.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
    if axis:
        tags = g.tags.where((c("axis") == axis) & (c("value_code").startswith(value) if value else F.lit(True)))
        out = out.join(tags, c("id") == c("entity_id"), "left_semi")
    return with_tags(g, out.select("id", "label"))


def _with_tags_sql(where):
    return f"WITH {_TAGS} SELECT id, label, tags FROM entities e LEFT JOIN tm ON tm.entity_id = e.id WHERE {where}"


@query("q_crafts", _with_tags_sql("label ILIKE '%ring%' AND entity_type = 'work'"))
def q_crafts(g):
    return filtered(g, "ring", "work")


@query("q_literature", f"WITH {_TAGS} SELECT DISTINCT s.other AS author, e.id, e.label, tags FROM entities e JOIN sym s ON s.node = e.id AND s.connection_type = 'creator_work' LEFT JOIN tm ON tm.entity_id = e.id WHERE e.entity_type = 'work'")
def q_literature(g):
    """Each author's works, by either end of the edge, with their tags."""
    by = g.both_ways.where(c("connection_type") == "creator_work").select(c("other").alias("author"), c("node").alias("id"))
    works = with_tags(g, g.entities.where("entity_type = 'work'").select("id", "label"))
    return by.distinct().join(works, "id")


@query("q_artworks", _with_tags_sql("entity_type = 'work' AND EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND axis = 'medium' AND value_code LIKE 'Brand#1%')"))
def q_artworks(g):
    return filtered(g, kind="work", axis="medium", value="Brand#1")


@query("q_festivals", _with_tags_sql("entity_type = 'place' AND EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND axis = 'geography' AND value_code LIKE 'EUROPE%')"))
def q_festivals(g):
    return filtered(g, kind="place", axis="geography", value="EUROPE")


@query("q_masters", f"WITH {_TAGS} SELECT id, label, tags, other FROM (SELECT e.id, e.label, s.other, row_number() OVER (PARTITION BY e.id ORDER BY s.score DESC, s.other) AS rn FROM entities e JOIN sym s ON s.node = e.id AND s.verdict = 'keep' WHERE e.entity_type = 'person' AND e.source = 'BUILDING') t LEFT JOIN tm ON tm.entity_id = t.id WHERE rn <= 5")
def q_masters(g, k=5):
    """Persons of a field with their tags and best five edges."""
    people = g.entities.where("entity_type = 'person' and source = 'BUILDING'").select("id", "label")
    best = first_per(both_ways(g.kept).join(people, c("node") == c("id")), ["id"], [F.desc("score"), "other"]).where(c("rn") <= k)
    return with_tags(g, best.select("id", "label", "other"))


@query("q_by_year", "SELECT e.id FROM entities e WHERE release_year BETWEEN 1900 AND 1950 AND EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND axis = 'medium' AND value_code = 'Brand#3') AND contains(lower(label), 'e')")
def q_by_year(g, low=1900, high=1950, medium="Brand#3", keyword="e"):
    tagged = g.tags.where((c("axis") == "medium") & (c("value_code") == medium))
    return search(g, keyword).where(c("release_year").between(low, high)).join(tagged, c("id") == c("entity_id"), "left_semi").select("id")


def _today_sql():
    hits = lambda words, most, test: " UNION ALL ".join(f"SELECT * FROM (SELECT {m} AS month, label AS name, entity_type AS type FROM entities WHERE contains(label, '{w}') AND {test} ORDER BY id LIMIT {most})" for m, ws in words.items() for w in ws)
    days = " UNION ALL ".join(f"SELECT {m} AS month, '{name}' AS name, '{kind}' AS type" for m, events in CALENDAR.items() for name, kind in events)
    fests = hits(MONTH_WORDS, 10, "entity_type IN ('festival', 'event', 'cultural_practice')")
    return f"SELECT month, 'calendar' AS part, name, type FROM ({days}) d UNION ALL SELECT DISTINCT month, 'festival', name, type FROM ({fests}) f UNION ALL SELECT DISTINCT month, 'season', name, type FROM ({hits(SEASON_WORDS, 5, 'TRUE')}) s"


def _found_by(entities, words, most):
    """The first ``most`` entities by id that hold each word: (month, name, type). One pass over the labels; the words are some dozens."""
    pairs = [F.when(F.contains("label", F.lit(w)), F.struct(F.lit(m).alias("month"), F.lit(w).alias("word"))) for m, ws in words.items() for w in ws]
    hits = entities.withColumn("hit", F.explode(F.array_compact(F.array(*pairs)))).select("id", "label", "entity_type", "hit.month", "hit.word")
    few = first_per(hits, ["month", "word"], ["id"]).where(c("rn") <= most)
    return few.select("month", c("label").alias("name"), c("entity_type").alias("type")).distinct()


@query("q_today", _today_sql())
def q_today(g):
    """Of every month: what the calendar has, festivals found by the month's words, and seasonal things."""
    days = g.spark.createDataFrame([(m, name, kind) for m, events in CALENDAR.items() for name, kind in events], "month int, name string, type string")
    e = g.entities.select("id", "label", "entity_type")
    parts = (("calendar", days), ("festival", _found_by(e.where(c("entity_type").isin("festival", "event", "cultural_practice")), MONTH_WORDS, 10)), ("season", _found_by(e, SEASON_WORDS, 5)))
    return reduce(lambda a, b: a.unionByName(b), [df.select("month", F.lit(part).alias("part"), "name", "type") for part, df in parts])


# ---- graph walks


def best_edges(edges, k):
    """The k best edges of each node. They don't depend on where a walk began, so they are ranked once, before any join."""
    return first_per(edges, ["node"], [F.desc("score"), "other"]).where(c("rn") <= k).select("node", "other")


@query(
    "q_explore",
    """WITH e AS (SELECT node, other, score FROM sym WHERE verdict = 'keep'), s0 AS (SELECT id AS start FROM entities WHERE entity_type = 'place'),
l1 AS (SELECT start, other AS node FROM (SELECT start, other, row_number() OVER (PARTITION BY start ORDER BY score DESC, other) AS rn FROM s0 JOIN e ON e.node = start) t WHERE rn <= 5),
l2a AS (SELECT start, other FROM (SELECT l1.start, e.other, row_number() OVER (PARTITION BY l1.start, l1.node ORDER BY score DESC, other) AS rn FROM l1 JOIN e ON e.node = l1.node) t WHERE rn <= 5),
l2 AS (SELECT DISTINCT start, other AS node FROM l2a WHERE other <> start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = l2a.start AND l1.node = l2a.other))
SELECT start, 1 AS hop, count(*) AS n FROM l1 GROUP BY start UNION ALL SELECT start, 2, count(*) FROM l2 GROUP BY start""",
)
def q_explore(g, hops=2, k=5):
    """Neighbourhoods of many starts at once: each hop is a join with the k best edges of each node, without what was seen."""
    best = best_edges(both_ways(g.kept).select("node", "other", "score"), k)
    starts = g.entities.where("entity_type = 'place'").select(c("id").alias("start"), c("id").alias("node"))
    seen, frontier, out = starts, starts, None
    for hop in range(1, hops + 1):
        reached = frontier.join(best, "node").select("start", c("other").alias("node")).distinct()
        frontier = reached.join(seen, ["start", "node"], "left_anti")
        level = frontier.groupBy("start").agg(F.count("*").alias("n")).select("start", F.lit(hop).alias("hop"), "n")
        out = level if out is None else out.unionByName(level)
        seen = seen.unionByName(frontier)
    return out


def _walk_sql(steps):
    step = """w{n} AS (SELECT start, other AS at, list_append(seen, other) AS seen FROM (SELECT w.start, w.seen, e.other, row_number() OVER (PARTITION BY w.start ORDER BY e.score + CASE WHEN x.eras <> y.eras THEN 0.3 ELSE 0 END + CASE WHEN x.media <> y.media THEN 0.3 ELSE 0 END DESC, e.rn) AS rk
  FROM w{p} w JOIN e ON e.node = w.at AND NOT list_contains(w.seen, e.other) LEFT JOIN ts x ON x.entity_id = w.at LEFT JOIN ts y ON y.entity_id = e.other WHERE coalesce(y.places, 'ASIA') = 'ASIA') t WHERE rk = 1)"""
    return f"""WITH e AS (SELECT node, other, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS rn FROM sym WHERE verdict = 'keep') s WHERE rn <= 50),
ts AS (SELECT entity_id, string_agg(value_code, ',' ORDER BY value_code) FILTER (WHERE axis = 'era') AS eras, string_agg(value_code, ',' ORDER BY value_code) FILTER (WHERE axis = 'medium') AS media, max(value_code) FILTER (WHERE axis = 'geography') AS places FROM entity_tags GROUP BY entity_id),
w0 AS (SELECT id AS start, id AS at, [id] AS seen FROM entities WHERE entity_type = 'person'),
{', '.join(step.format(n=n, p=n - 1) for n in range(1, steps + 1))}
{' UNION ALL '.join(f"SELECT start, {n} AS step, array_to_string(seen, '>') AS path FROM w{n}" for n in range(1, steps + 1))}"""


@query("q_serendipity_walk", _walk_sql(3))
def q_serendipity_walk(g, steps=3, fan=50, region="ASIA", bonus=0.3):
    """Greedy walks of 3 to 10 steps from all persons at once: over each node's best kept edges, never back, three tenths more for another era and another medium; a node tagged with places has to be of the region."""
    if not 3 <= steps <= 10:
        raise ValueError("a walk has 3 to 10 steps")
    best = first_per(both_ways(g.kept), ["node"], [F.desc("score"), "other"]).where(c("rn") <= fan).select("node", "other", "score", "rn")
    of = lambda axis: F.array_sort(F.collect_set(F.when(c("axis") == axis, c("value_code"))))
    sets = g.tags.where(c("axis").isin("era", "medium", "geography")).groupBy("entity_id").agg(of("era").alias("eras"), of("medium").alias("media"), of("geography").alias("places"))
    here = sets.select(c("entity_id").alias("node"), c("eras").alias("x_eras"), c("media").alias("x_media"))
    there = sets.select(c("entity_id").alias("other"), "eras", "media", "places")
    edges = best.join(there, "other", "left").where(c("places").isNull() | (F.size("places") == 0) | F.array_contains("places", region)).join(here, "node", "left")
    differ = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0) & (c(a) != c(b)), bonus).otherwise(0.0)
    edges = edges.select("node", "other", "rn", (c("score") + differ("x_eras", "eras") + differ("x_media", "media")).alias("gain"))
    walk = g.entities.where("entity_type = 'person'").select(c("id").alias("start"), c("id").alias("node"), F.array("id").alias("seen"))
    out = None
    for n in range(1, steps + 1):
        nexts = walk.join(edges, "node").where(~F.array_contains("seen", c("other")))
        one = F.min(F.struct((-c("gain")).alias("s"), "rn", "other", "seen"))
        walk = nexts.groupBy("start").agg(one.alias("o")).select("start", c("o.other").alias("node"), F.array_append(c("o.seen"), c("o.other")).alias("seen"))
        path = walk.select("start", F.lit(n).alias("step"), F.array_join(F.transform("seen", lambda x: x.cast("string")), ">").alias("path"))
        out = path if out is None else out.unionByName(path)
    return out


def _compare_sql(depth):
    levels = ["n0 AS (SELECT id AS start, id AS node FROM pl)"] + [f"n{d} AS (SELECT DISTINCT n.start, e.other AS node FROM n{d - 1} n JOIN e ON e.node = n.node)" for d in range(1, depth + 1)]
    return f"""WITH e AS (SELECT node, other FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS rn FROM sym WHERE verdict = 'keep') t WHERE rn <= 20),
pl AS (SELECT id, source FROM entities WHERE entity_type = 'place'), {', '.join(levels)},
s AS (SELECT DISTINCT start, node FROM ({' UNION ALL '.join(f'SELECT * FROM n{d}' for d in range(depth + 1))}) u),
p AS (SELECT a.id AS a_id, b.id AS b_id FROM pl a JOIN pl b ON b.id = a.id + 1 AND a.source = b.source),
m AS (SELECT a_id, b_id, node, max(w) AS w, sum(w) AS both_ FROM (SELECT a_id, b_id, node, 1 AS w FROM p JOIN s ON s.start = a_id UNION ALL SELECT a_id, b_id, node, 2 FROM p JOIN s ON s.start = b_id) u WHERE node <> a_id AND node <> b_id GROUP BY 1, 2, 3),
tg AS (SELECT entity_id, axis || '=' || value_code AS t FROM entity_tags),
k AS (SELECT a_id, b_id, t, sum(w) AS both_ FROM (SELECT DISTINCT a_id, b_id, t, 1 AS w FROM p JOIN tg ON entity_id = a_id UNION ALL SELECT DISTINCT a_id, b_id, t, 2 FROM p JOIN tg ON entity_id = b_id) u GROUP BY 1, 2, 3),
kk AS (SELECT a_id, b_id, string_agg(t, ',' ORDER BY t) FILTER (WHERE both_ = 3) AS shared_tags, string_agg(t, ',' ORDER BY t) FILTER (WHERE both_ = 1) AS a_tags, string_agg(t, ',' ORDER BY t) FILTER (WHERE both_ = 2) AS b_tags FROM k GROUP BY 1, 2),
mm AS (SELECT a_id, b_id, count(*) FILTER (WHERE both_ = 3) AS common, count(*) FILTER (WHERE both_ = 1) AS a_only, count(*) FILTER (WHERE both_ = 2) AS b_only FROM m GROUP BY 1, 2)
SELECT p.a_id, p.b_id, coalesce(common, 0) AS common, coalesce(a_only, 0) AS a_only, coalesce(b_only, 0) AS b_only, coalesce(shared_tags, '') AS shared_tags, coalesce(a_tags, '') AS a_tags, coalesce(b_tags, '') AS b_tags FROM p LEFT JOIN mm USING (a_id, b_id) LEFT JOIN kk USING (a_id, b_id)"""


@query("q_compare", _compare_sql(2))
def q_compare(g, k=20, depth=2):
    """Two places and what lies within ``depth`` kept edges of each, k a node: common, in one alone, and the same of their tags. Neighbourhoods have k + ... + k^depth nodes at most."""
    e = first_per(both_ways(g.kept), ["node"], [F.desc("score"), "other"]).where(c("rn") <= k).select("node", "other")
    places = g.entities.where("entity_type = 'place'").select("id", "source")
    level = places.select(c("id").alias("start"), c("id").alias("node"))
    reached = level
    for _ in range(depth):
        level = level.join(e, "node").select("start", c("other").alias("node")).distinct()
        reached = reached.unionByName(level)
    nodes = reached.groupBy("start").agg(F.collect_set("node").alias("s"))
    tags = g.tags.groupBy(c("entity_id").alias("start")).agg(F.collect_set(F.concat_ws("=", "axis", "value_code")).alias("t"))
    sets = nodes.join(tags, "start", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    p = places.select(c("id").alias("a_id"), (c("id") + 1).alias("b_id"), "source").join(places.select(c("id").alias("b_id"), "source"), ["b_id", "source"])
    both = p.join(sets.toDF("a_id", "x", "xt"), "a_id").join(sets.toDF("b_id", "y", "yt"), "b_id")
    ends = F.array("a_id", "b_id")
    x, y = F.array_except("x", ends), F.array_except("y", ends)
    size = lambda e: F.size(e).cast("long")
    text = lambda e: F.array_join(F.array_sort(e), ",")
    return both.select(
        "a_id", "b_id",
        size(F.array_intersect(x, y)).alias("common"), size(F.array_except(x, y)).alias("a_only"), size(F.array_except(y, x)).alias("b_only"),
        text(F.array_intersect("xt", "yt")).alias("shared_tags"), text(F.array_except("xt", "yt")).alias("a_tags"), text(F.array_except("yt", "xt")).alias("b_tags"),
    )


_KIND_SQL = "CASE " + " ".join(f"WHEN connection_type IN ({', '.join(map(repr, types))}) THEN '{kind}'" for kind, types in NEIGHBOUR_KINDS) + " ELSE 'other' END"


@query(
    "q_deep_dive",
    f"""WITH e AS (SELECT * FROM (SELECT node, other, connection_type, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS rn FROM sym WHERE verdict = 'keep' AND node >= 3000000000000) t WHERE rn <= 100),
k AS (SELECT node, {_KIND_SQL} AS category, other, score, connection_type FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node, category ORDER BY score DESC, other) AS rk, count(*) OVER (PARTITION BY node, category) AS n, count(*) OVER (PARTITION BY node) AS total FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, category) AS pos FROM r WHERE rk = 1)
SELECT node, category, other AS recommendation, connection_type, {micro_sql('score')} AS score6, n, total, pos FROM b WHERE pos <= 5""",
)
def q_deep_dive(g, edges=100, n=5):
    """Of each work's best hundred kept edges, by kind of neighbour: the best one and how many there are; the best n kinds."""
    few = first_per(both_ways(g.kept).where("node >= 3000000000000"), ["node"], [F.desc("score"), "other"]).where(c("rn") <= edges)
    kind = F.lit("other")
    for name, types in reversed(NEIGHBOUR_KINDS):
        kind = F.when(c("connection_type").isin(*types), name).otherwise(kind)
    best = F.min(F.struct((-c("score")).alias("s"), "other", "connection_type", "score"))
    per = few.withColumn("category", kind).groupBy("node", "category").agg(best.alias("b"), n_rows())
    every = Window.partitionBy("node")
    out = per.select("node", "category", c("b.other").alias("recommendation"), c("b.connection_type"), micro(c("b.score")).alias("score6"), c("b.score").alias("score"), "n", F.sum("n").over(every).alias("total"))
    return first_per(out, ["node"], [F.desc("score"), "category"], "pos").where(c("pos") <= n).drop("score").withColumn("pos", c("pos").cast("long"))


# ---- routes, maps, timelines


@query(
    "q_cultural_route",
    f"""WITH t AS (SELECT e.id, e.lat, e.lon FROM entities e WHERE e.lat BETWEEN {degree_box(34.7, 135.5, 100)[0]!r} AND {degree_box(34.7, 135.5, 100)[1]!r} AND e.lon BETWEEN {degree_box(34.7, 135.5, 100)[2]!r} AND {degree_box(34.7, 135.5, 100)[3]!r}
  AND EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND t.axis = 'theme' AND t.value_code LIKE 'ECONOMY%') ORDER BY md5('route' || CAST(e.id AS VARCHAR)), e.id LIMIT 20),
k AS (SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rn) AS links FROM (SELECT t.id, s.other, row_number() OVER (PARTITION BY t.id ORDER BY s.score DESC, s.other) AS rn FROM t JOIN sym s ON s.node = t.id AND s.verdict = 'keep') q WHERE rn <= 3 GROUP BY id)
SELECT t.id, CAST(floor((lon + 180.0) / 360.0 * 4096) AS BIGINT) AS x, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096) AS BIGINT) AS y, links FROM t LEFT JOIN k USING (id)""",
)
def q_cultural_route(g, theme="ECONOMY", centre=(34.7, 135.5, 100), n=20, k=3):
    """A sample of places of a theme within a region's box, each with its tile and its k best kept edges."""
    low, high, west, east = degree_box(*centre)
    tagged = g.tags.where((c("axis") == "theme") & c("value_code").startswith(theme))
    few = g.entities.where(c("lat").between(low, high) & c("lon").between(west, east)).select("id", "lat", "lon").join(tagged, c("id") == c("entity_id"), "left_semi").orderBy(hash_order("route"), "id").limit(n)
    best = first_per(both_ways(g.kept).join(F.broadcast(few.select("id")), c("node") == c("id")), ["id"], [F.desc("score"), "other"]).where(c("rn") <= k)
    links = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"].cast("string")), ",").alias("links"))
    x, y = geo.tile_xy(c("lat"), c("lon"), 12)
    return few.join(links, "id", "left").select("id", x.alias("x"), y.alias("y"), "links")


_SPOT = "connection_type LIKE 'pilgrimage%'"


@query("q_pilgrimage_by_work", f"SELECT s.node AS work, e.id AS place, e.lat, e.lon FROM sym s JOIN entities e ON e.id = s.other WHERE s.{_SPOT} AND s.node >= 3000000000000 AND e.lat IS NOT NULL")
def q_pilgrimage_by_work(g):
    """Each work's places, from either end of an edge. (These edges have no text of their own to match.)"""
    s = g.both_ways.where(c("connection_type").startswith("pilgrimage") & (c("node") >= 3000000000000)).select(c("node").alias("work"), c("other").alias("place"))
    return s.join(g.entities.where("lat is not null").select(c("id").alias("place"), "lat", "lon"), "place").select("work", "place", "lat", "lon")


_BOX = degree_box(35.0, 136.0, 20)
_KM = "sqrt(pow((lat - 35.0) * 111.0, 2) + pow((lon - 136.0) * 111.0 * cos(radians(CAST(35.0 AS DOUBLE))), 2))"


@query("q_pilgrimage_near", f"SELECT DISTINCT e.id, {micro_sql(_KM)} AS km6 FROM entities e JOIN sym s ON s.node = e.id AND s.{_SPOT} WHERE lat BETWEEN {_BOX[0]!r} AND {_BOX[1]!r} AND lon BETWEEN {_BOX[2]!r} AND {_BOX[3]!r} AND {_KM} <= 20")
def q_pilgrimage_near(g, box=_BOX, km=20.0):
    spots = g.both_ways.where(c("connection_type").startswith("pilgrimage"))
    away = geo.equirect_km(F.lit(35.0), F.lit(136.0), c("lat"), c("lon"))
    near = g.entities.where(c("lat").between(box[0], box[1]) & c("lon").between(box[2], box[3])).select("id", away.alias("km")).where(c("km") <= km)
    return near.join(spots, c("id") == c("node"), "left_semi").select("id", micro(c("km")).alias("km6"))


@query("q_pilgrimage_browse", f"SELECT node AS work, count(DISTINCT other) AS places FROM sym WHERE {_SPOT} AND node >= 3000000000000 GROUP BY node ORDER BY places DESC, work LIMIT 50")
def q_pilgrimage_browse(g, n=50):
    s = g.both_ways.where(c("connection_type").startswith("pilgrimage") & (c("node") >= 3000000000000))
    return s.groupBy(c("node").alias("work")).agg(F.count_distinct("other").alias("places")).orderBy(F.desc("places"), "work").limit(n)


@query("q_pilgrimage_route")
def q_pilgrimage_route(g, most=20, reach=0.5, fill=10):
    """For each work its first places and, within half a degree of their middle, the artifacts with the least ids (``fill`` at most, to ``most`` in all), in nearest-neighbour order."""
    s = both_ways(g.edges.where(c("connection_type").startswith("pilgrimage"))).where("node >= 3000000000000").select(c("node").alias("work"), c("other").alias("place"))
    at = s.join(g.entities.where("lat is not null").select(c("id").alias("place"), "lat", "lon"), "place").select("work", "place", "lat", "lon")
    few = first_per(at, ["work"], ["place"]).where(c("rn") <= most).groupBy("work").agg(F.array_sort(F.collect_list(F.struct("place", "lat", "lon"))).alias("own"))
    mean = lambda x: F.aggregate("own", F.lit(0.0), lambda a, p: a + p[x]) / F.size("own")
    routes = materialized(g.spark, few.select("work", "own", mean("lat").alias("mid_lat"), mean("lon").alias("mid_lon")))
    filled = _first_found(g, routes.select("work", "mid_lat", "mid_lon"), reach, fill)
    stops = routes.join(filled, "work", "left").select("work", F.concat("own", F.slice(F.coalesce("found", F.array()), 1, F.greatest(F.lit(0), F.lit(most) - F.size("own")))).alias("stops"))
    return stops.select("work", F.array_sort("stops").alias("stops")).mapInArrow(routes_in_order, "work long, place long, pos int")


def _first_in_box(g, middle, reach, n):
    """(work, id, lat, lon) of what ``_first_found`` lists, with middle's other columns."""
    found = _first_found(g, middle.select("work", "mid_lat", "mid_lon"), reach, n).select("work", F.explode("found").alias("p"))
    return middle.drop("mid_lat", "mid_lon").join(found, "work").select(*[x for x in middle.columns if x not in ("mid_lat", "mid_lon")], c("p.place").alias("id"), "p.lat", "p.lon")


def _first_found(g, middle, reach, n, deep=64, cuts=4):
    """(work, found): the n awake artifacts with the least ids within the box of each work.

    A work looks at the ``deep`` least ids of each cell that its box meets.
    What it finds there is right up to the last id of any such list that was
    cut and has fewer than n in the box; works to which that leaves fewer than
    n are asked again, cell by cell.
    """
    cell = lambda x, step: F.floor(x / step)
    culture = g.entities.where("lat is not null and entity_type = 'artifact' and is_dormant = 0").select(c("id").alias("place"), "lat", "lon")
    coarse = culture.withColumns({"cy": cell(c("lat"), reach), "cx": cell(c("lon"), reach)})
    lists = first_per(coarse, ["cy", "cx"], ["place"]).where(c("rn") <= deep + 1).groupBy("cy", "cx").agg(F.array_sort(F.collect_list(F.struct("place", "lat", "lon"))).alias("all"))
    lists = lists.select("cy", "cx", F.slice("all", 1, deep).alias("list"), F.when(F.size("all") > deep, F.get("all", F.lit(deep - 1))["place"]).alias("last"))
    span = lambda x, step: F.explode(F.sequence(cell(c(x) - reach, step), cell(c(x) + reach, step)))
    inside = lambda p: (F.abs(p["lat"] - c("mid_lat")) <= reach) & (F.abs(p["lon"] - c("mid_lon")) <= reach)
    met = middle.withColumn("cy", span("mid_lat", reach)).withColumn("cx", span("mid_lon", reach)).join(lists, ["cy", "cx"])
    seen = met.select("work", "mid_lat", "mid_lon", "last", F.slice(F.filter("list", inside), 1, n).alias("found"))
    upto = F.min(F.when(F.size("found") < n, c("last"))).alias("upto")
    best = seen.groupBy("work", "mid_lat", "mid_lon").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, n).alias("found"), upto)
    sure = c("upto").isNull() | ((F.size("found") == n) & (F.get("found", F.lit(n - 1))["place"] <= c("upto")))
    best = materialized(g.spark, best.withColumn("sure", sure))
    again = _first_by_cells(culture, best.where("not sure").select("work", "mid_lat", "mid_lon"), reach, n, cuts)
    return best.where("sure").select("work", "found").unionByName(again)


def _first_by_cells(culture, middle, reach, n, cuts):
    """The same for any layout. Of a cell wholly inside only the first n can count, and of one place; cells of the rim are read whole but for that."""
    step = reach / cuts
    cell = lambda x: F.floor(x / step)
    placed = first_per(culture, ["lat", "lon"], ["place"]).where(c("rn") <= n).select("place", "lat", "lon", cell(c("lat")).alias("cy"), cell(c("lon")).alias("cx"))
    span = lambda x: F.explode(F.sequence(cell(c(x) - reach), cell(c(x) + reach)))
    within = lambda cell_, x: (c(cell_) * step >= c(x) - reach) & ((c(cell_) + 1) * step <= c(x) + reach)
    cells = middle.withColumn("cy", span("mid_lat")).withColumn("cx", span("mid_lon")).withColumn("inner", within("cy", "mid_lat") & within("cx", "mid_lon"))
    few = first_per(placed, ["cy", "cx"], ["place"]).where(c("rn") <= n).drop("rn")
    both = cells.where("inner").join(few, ["cy", "cx"]).unionByName(cells.where("not inner").join(placed, ["cy", "cx"]))
    held = both.where((F.abs(c("lat") - c("mid_lat")) <= reach) & (F.abs(c("lon") - c("mid_lon")) <= reach)).select("work", "place", "lat", "lon")
    first = first_per(held, ["work"], ["place"]).where(c("rn") <= n)
    return first.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("place", "lat", "lon"))).alias("found"))


@query(
    "q_nearby",
    f"""WITH {_TAGS}, p AS (SELECT id, {_KM} AS km, abs(lat - 35.0) + abs(lon - 136.0) AS flat FROM entities WHERE lat BETWEEN {_BOX[0]!r} AND {_BOX[1]!r} AND lon BETWEEN {_BOX[2]!r} AND {_BOX[3]!r} AND is_dormant = 0),
f AS (SELECT id, km FROM p ORDER BY floor(flat * 1e6 + 0.5), id LIMIT 80), h AS (SELECT id, km FROM f WHERE km <= 20 ORDER BY floor(km * 1e6 + 0.5), id LIMIT 40),
w AS (SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rn) AS works FROM (SELECT h.id, s.other, row_number() OVER (PARTITION BY h.id ORDER BY s.score DESC, s.other) AS rn FROM h JOIN sym s ON s.node = h.id AND s.other BETWEEN 3000000000000 AND 3999999999999) q WHERE rn <= 3 GROUP BY id)
SELECT h.id, {micro_sql('km')} AS km6, tags, works FROM h LEFT JOIN tm ON tm.entity_id = h.id LEFT JOIN w ON w.id = h.id""",
)
def q_nearby(g, box=_BOX, km=20.0, n=40, k=3):
    """What is near a point: twice n by the sum of degrees, of these those within the radius, n by distance, with tags and three works."""
    away = geo.equirect_km(F.lit(35.0), F.lit(136.0), c("lat"), c("lon"))
    flat = F.floor((F.abs(c("lat") - 35.0) + F.abs(c("lon") - 136.0)) * 1e6 + 0.5)
    first = g.entities.where("is_dormant = 0").where(c("lat").between(box[0], box[1]) & c("lon").between(box[2], box[3])).select("id", away.alias("km"), flat.alias("flat")).orderBy("flat", "id").limit(2 * n)
    near = first.where(c("km") <= km).select("id", micro(c("km")).alias("km6")).orderBy("km6", "id").limit(n)
    works = g.both_ways.where(c("other").between(3_000_000_000_000, 3_999_999_999_999)).join(F.broadcast(near.select("id")), c("node") == c("id"))
    best = first_per(works, ["id"], [F.desc("score"), "other"]).where(c("rn") <= k)
    lists = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"].cast("string")), ",").alias("works"))
    return with_tags(g, near, "id").join(lists, "id", "left").select("id", "km6", "tags", "works")


@query(
    "q_timeline",
    f"""WITH hits AS (SELECT id FROM entities WHERE contains(lower(label), 'bolt') ORDER BY id LIMIT 200),
r AS (SELECT h.id, EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = h.id AND axis = 'geography' AND value_code = 'ASIA') AS here FROM hits h),
k AS (SELECT id FROM r WHERE here OR NOT (SELECT bool_or(here) FROM r)),
er AS (SELECT entity_id, value_code, {era_midpoint('value_code')} AS middle, row_number() OVER (PARTITION BY entity_id ORDER BY {era_midpoint('value_code')}, value_code) AS rn FROM entity_tags WHERE axis = 'era')
SELECT k.id, value_code AS era, middle, row_number() OVER (ORDER BY middle, k.id) AS pos FROM k JOIN er ON er.entity_id = k.id AND rn = 1""",
)
def q_timeline(g, keyword="bolt", region="ASIA", n=200):
    """The first hits by the middle of their earliest era; those of the region alone, if it has any."""
    hits = search(g, keyword).orderBy("id").limit(n).select("id")
    here = g.tags.where((c("axis") == "geography") & (c("value_code") == region)).select(c("entity_id").alias("id")).distinct().withColumn("here", F.lit(True))
    at = hits.join(here, "id", "left")  # n rows at most, so one window may hold them
    kept = at.withColumn("some", F.coalesce(F.bool_or("here").over(Window.partitionBy(F.lit(1))), F.lit(False))).where("here or not some").select("id")
    middle = F.expr(era_midpoint("value_code"))
    era = g.tags.where("axis = 'era'").groupBy("entity_id").agg(F.min(F.struct(middle.alias("middle"), c("value_code").alias("era"))).alias("e"))
    out = era.join(F.broadcast(kept), c("entity_id") == c("id")).select("id", "e.era", "e.middle")
    return out.withColumn("pos", F.row_number().over(Window.orderBy("middle", "id")).cast("long"))


_POINT_SQL = "'{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(e.lon AS VARCHAR) || ',' || CAST(e.lat AS VARCHAR) || ']},\"properties\":{"


def feature(lon, lat, **properties):
    """A point feature as JSON: coordinates are [lon, lat]."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))


@query("q_map_work", f"SELECT s.node AS work, e.id AS place, {_POINT_SQL}\"id\":' || CAST(e.id AS VARCHAR) || ',\"label\":\"' || e.label || '\",\"work\":' || CAST(s.node AS VARCHAR) || '}}}}' AS feature FROM sym s JOIN entities e ON e.id = s.other WHERE s.{_SPOT} AND s.node >= 3000000000000 AND e.lat IS NOT NULL")
def q_map_work(g):
    """Features of each work's places."""
    names = g.entities.select(c("id").alias("place"), "label")
    rows = q_pilgrimage_by_work(g).join(names, "place")
    return rows.select("work", "place", feature(c("lon"), c("lat"), id=c("place"), label=c("label"), work=c("work")).alias("feature"))


@query("q_map_theme", f"SELECT e.id, t.value_code AS theme, {_POINT_SQL}\"id\":' || CAST(e.id AS VARCHAR) || ',\"theme\":\"' || t.value_code || '\",\"type\":\"' || e.entity_type || '\"}}}}' AS feature FROM entities e JOIN entity_tags t ON t.entity_id = e.id AND t.axis = 'theme' WHERE e.lat IS NOT NULL")
def q_map_theme(g):
    themes = g.tags.where("axis = 'theme'").select(c("entity_id").alias("id"), c("value_code").alias("theme"))
    rows = g.entities.where("lat is not null").select("id", "lat", "lon", "entity_type").join(themes, "id")
    return rows.select("id", "theme", feature(c("lon"), c("lat"), id=c("id"), theme=c("theme"), type=c("entity_type")).alias("feature"))


@query(
    "q_pilgrimage_timeline",
    f"""WITH r AS (SELECT DISTINCT e.release_year AS year, e.id AS work, s.other AS place FROM sym s JOIN entities e ON e.id = s.node WHERE s.{_SPOT} AND e.release_year BETWEEN 1600 AND 2024 ORDER BY 1, 2, 3 LIMIT 300),
k AS (SELECT *, row_number() OVER (PARTITION BY year, work ORDER BY place) AS rn FROM r) SELECT year, work, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE rn <= 5) AS places FROM k GROUP BY year, work""",
)
def q_pilgrimage_timeline(g, low=1600, high=2024, n=100, most=5):
    """Works by year with their places: the first 3n rows by year, work and place, of each work five places and their count."""
    s = g.both_ways.where(c("connection_type").startswith("pilgrimage")).select(c("node").alias("work"), c("other").alias("place"))
    y = g.entities.where(c("release_year").between(low, high)).select(c("id").alias("work"), c("release_year").alias("year"))
    few = s.join(y, "work").select("year", "work", "place").distinct().orderBy("year", "work", "place").limit(3 * n)
    lists = F.slice(F.array_sort(F.collect_list("place")), 1, most)
    return few.groupBy("year", "work").agg(n_rows(), F.array_join(F.transform(lists, lambda x: x.cast("string")), ",").alias("places"))


@query(
    "q_emergence",
    f"""WITH r AS (SELECT DISTINCT e.release_year AS year, e.id AS work, s.other AS place FROM sym s JOIN entities e ON e.id = s.node WHERE s.{_SPOT} AND e.entity_type = 'work' AND e.release_year BETWEEN 1600 AND 2024),
fw AS (SELECT year, count(*) AS n FROM (SELECT work, min(year) AS year FROM r GROUP BY work) q GROUP BY year), fp AS (SELECT year, count(*) AS n FROM (SELECT place, min(year) AS year FROM r GROUP BY place) q GROUP BY year),
y AS (SELECT CAST(unnest(range(1600, 2025)) AS INT) AS year), t AS (SELECT y.year, coalesce(fw.n, 0) AS new_works, coalesce(fp.n, 0) AS new_places FROM y LEFT JOIN fw USING (year) LEFT JOIN fp USING (year)),
ty AS (SELECT e.entity_type, count(*) AS k FROM entities e WHERE e.id IN (SELECT place FROM r) GROUP BY 1), tot AS (SELECT sum(k) AS k FROM ty)
SELECT 'year' AS part, year, new_works, new_places, CAST(sum(new_works) OVER (ORDER BY year) AS BIGINT) AS all_works, CAST(sum(new_places) OVER (ORDER BY year) AS BIGINT) AS all_places, CAST(NULL AS BIGINT) AS value FROM t
UNION ALL SELECT 'peak', NULL, NULL, NULL, NULL, NULL, (SELECT CAST(year AS BIGINT) FROM t ORDER BY new_places DESC, year LIMIT 1)
UNION ALL SELECT 'rate6', NULL, NULL, NULL, NULL, NULL, {micro_sql('count(DISTINCT place) / 425.0')} FROM r
UNION ALL SELECT 'density6', NULL, NULL, NULL, NULL, NULL, {micro_sql('count(DISTINCT place) / CAST(greatest(count(DISTINCT work), 1) AS DOUBLE)')} FROM r
UNION ALL SELECT 'entropy6', NULL, NULL, NULL, NULL, NULL, {micro_sql('coalesce(-sum(ty.k / CAST(tot.k AS DOUBLE) * ln(ty.k / CAST(tot.k AS DOUBLE))), 0)')} FROM ty, tot
UNION ALL SELECT 'together', NULL, NULL, NULL, NULL, NULL, count(*) FROM connections WHERE connection_type = 'same_source' AND (a_id IN (SELECT place FROM r) OR b_id IN (SELECT place FROM r))""",
)
def q_emergence(g, low=1600, high=2024, types=("same_source",)):
    """How a network of works and places came up: new and cumulated ones by year, the first fullest year, places a year, places a work, entropy of the places' types, and edges of other types at these places."""
    s = g.both_ways.where(c("connection_type").startswith("pilgrimage")).select(c("node").alias("work"), c("other").alias("place"))
    y = g.entities.where((c("entity_type") == "work") & c("release_year").between(low, high)).select(c("id").alias("work"), c("release_year").alias("year"))
    rows = s.join(y, "work").select("year", "work", "place").distinct()
    first = lambda key: rows.groupBy(key).agg(F.min("year").alias("year")).groupBy("year").agg(n_rows())
    spine = g.spark.range(low, high + 1).select(c("id").cast("int").alias("year"))
    t = spine.join(first("work").withColumnRenamed("n", "w"), "year", "left").join(first("place").withColumnRenamed("n", "p"), "year", "left")
    t = t.select("year", F.coalesce("w", F.lit(0)).alias("new_works"), F.coalesce("p", F.lit(0)).alias("new_places"))
    by_year = Window.orderBy("year")  # as many rows as years
    none = F.lit(None).cast("long")
    years = t.select(F.lit("year").alias("part"), "year", "new_works", "new_places", F.sum("new_works").over(by_year).alias("all_works"), F.sum("new_places").over(by_year).alias("all_places"), none.alias("value"))
    alone = lambda df, part, value: df.select(F.lit(part).alias("part"), F.lit(None).cast("int").alias("year"), *[none.alias(x) for x in ("new_works", "new_places", "all_works", "all_places")], value.cast("long").alias("value"))
    totals = rows.agg(F.count_distinct("place").alias("places"), F.count_distinct("work").alias("works"))
    places = rows.select(c("place").alias("id")).distinct()
    kinds = g.entities.select("id", "entity_type").join(places, "id", "left_semi").groupBy("entity_type").agg(F.count("*").alias("k"))
    share = c("k") / F.sum("k").over(Window.partitionBy(F.lit(1)))  # one row for each type
    entropy = kinds.select((share * F.log(share)).alias("x")).agg(F.coalesce(-F.sum("x"), F.lit(0.0)).alias("h"))
    near = g.edges.where(c("connection_type").isin(*types)).select("a_id", "b_id")
    mark = lambda end: places.select(c("id").alias(end), F.lit(1).alias(f"{end}_in"))
    together = near.join(mark("a_id"), "a_id", "left").join(mark("b_id"), "b_id", "left").agg(F.count_if(c("a_id_in").isNotNull() | c("b_id_in").isNotNull()).alias("k"))
    parts = [
        alone(t.agg(F.min(F.struct((-c("new_places")).alias("m"), "year"))["year"].alias("v")), "peak", c("v")),
        alone(totals, "rate6", micro(c("places") / float(high - low + 1))),
        alone(totals, "density6", micro(c("places") / F.greatest("works", F.lit(1)))),
        alone(entropy, "entropy6", micro(c("h"))),
        alone(together, "together", c("k")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts, years)


# ---- exports


_EXPORT_SQL = {
    "pilgrimage": f"SELECT s.other AS place, s.node AS work, w.label FROM sym s JOIN entities w ON w.id = s.node WHERE s.{_SPOT} AND s.node >= 3000000000000 ORDER BY s.node, s.other LIMIT 500",
    "year": "SELECT id, label, release_year FROM entities WHERE release_year IS NOT NULL ORDER BY release_year, id LIMIT 500",
    "cross": "SELECT k.a_id, k.b_id, k.connection_type FROM connections k JOIN entities x ON x.id = k.a_id JOIN entities y ON y.id = k.b_id WHERE x.entity_type <> y.entity_type ORDER BY k.score DESC, k.a_id, k.b_id LIMIT 500",
    "geo": "SELECT id, lat, lon, entity_type FROM entities WHERE lat IS NOT NULL ORDER BY id LIMIT 500",
}


def _inside(g, box):
    """(id) of what lies in (south, north, west, east)."""
    south, north, west, east = box
    return g.entities.where(c("lat").between(south, north) & c("lon").between(west, east)).select("id")


def _first_joined(g, rows, order, joined, n):
    """The first n by ``order`` of ``joined(rows)``, which takes rows away or adds columns but keeps those of the order.

    The first 4 n rows are joined first. Where n of what they give are left,
    no later row comes before these; else all rows are joined.
    """
    head = rows.orderBy(*order).limit(4 * n)
    found = materialized(g.spark, joined(F.broadcast(head)).orderBy(*order).limit(n))
    return found if found.count() >= n else joined(rows).orderBy(*order).limit(n)


@query("q_export_pilgrimage", _EXPORT_SQL["pilgrimage"])
def q_export_pilgrimage(g, n=500, box=None):
    s = g.both_ways.where(c("connection_type").startswith("pilgrimage") & (c("node") >= 3000000000000)).select(c("other").alias("place"), c("node").alias("work"))
    s = s if box is None else s.join(_inside(g, box).withColumnRenamed("id", "place"), "place", "left_semi")
    named = lambda rows: rows.join(g.entities.select(c("id").alias("work"), "label"), "work").select("place", "work", "label")
    return _first_joined(g, s, ["work", "place"], named, n)


@query("q_export_year", _EXPORT_SQL["year"])
def q_export_year(g, n=500, box=None):
    e = g.entities.where("release_year is not null")
    e = e if box is None else e.join(_inside(g, box), "id", "left_semi")
    return e.orderBy("release_year", "id").limit(n).select("id", "label", "release_year")


@query("q_export_cross", _EXPORT_SQL["cross"])
def q_export_cross(g, n=500, box=None):
    kind = lambda end, name: g.entities.select(c("id").alias(end), c("entity_type").alias(name))
    k = g.edges
    if box is not None:  # either end may lie inside
        here = lambda end: k.join(_inside(g, box).withColumnRenamed("id", end), end, "left_semi")
        k = here("a_id").unionByName(here("b_id")).distinct()
    cross = lambda rows: rows.join(kind("a_id", "x"), "a_id").join(kind("b_id", "y"), "b_id").where("x <> y").drop("x", "y")
    return _first_joined(g, k.select("a_id", "b_id", "connection_type", "score"), [F.desc("score"), "a_id", "b_id"], cross, n).select("a_id", "b_id", "connection_type")


@query("q_export_geo", _EXPORT_SQL["geo"])
def q_export_geo(g, n=500, box=None):
    e = g.entities.where("lat is not null")
    e = e if box is None else e.join(_inside(g, box), "id", "left_semi")
    return e.orderBy("id").limit(n).select("id", "lat", "lon", "entity_type")


#: Datasets that sink_datasets can write, and what names a row of each.
DATASETS = {"pilgrimage": q_export_pilgrimage, "year": q_export_year, "cross": q_export_cross, "geo": q_export_geo}
DATASET_KEYS = {"pilgrimage": ("place", "work"), "year": ("id",), "cross": ("a_id", "b_id"), "geo": ("id",)}
DATASET_SQL = _EXPORT_SQL


def dataset_frames(g, names=None, n: int = 500, box: tuple[float, float, float, float] | None = None) -> dict:
    """Datasets by name: of each the first n rows, of all places or of those in a box (south, north, west, east)."""
    return {name: DATASETS[name](g, n, box) for name in (names or DATASETS)}


def sink_datasets(g, path: str, names=None, n: int = 500, box: tuple[float, float, float, float] | None = None, form: str = "json") -> None:
    """Write datasets, all or those named, into path/dataset=name; those that are not named stay as they were."""
    write_datasets(dataset_frames(g, names, n, box), path, form)
