"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.graph import both_ways, first_per
from .registry import query

c = F.col


def n_rows():
    return F.count("*").alias("n")


def micro(e):
    """A double as a whole number of millionths, so that results compare exactly."""
    return F.floor(e * 1e6 + 0.5).cast("long")


def micro_sql(e: str) -> str:
    return f"CAST(floor(({e}) * 1e6 + 0.5) AS BIGINT)"


@query("agg_count_by_top", "SELECT source, count(*) AS n FROM entities GROUP BY source ORDER BY n DESC, source LIMIT 10")
def agg_count_by_top(g, n=10):
    return g.entities.groupBy("source").agg(n_rows()).orderBy(F.desc("n"), "source").limit(n)


@query("agg_count_distinct", f"SELECT axis, count(DISTINCT entity_id) AS n, {micro_sql('count(DISTINCT entity_id) * 100.0 / (SELECT count(*) FROM entities)')} AS pct6 FROM entity_tags GROUP BY axis")
def agg_count_distinct(g, approximate=False):
    """Distinct entities of each axis, and their share of all; ``approximate`` uses a sketch."""
    total = g.entities.agg(F.count("*").alias("total"))
    count = F.approx_count_distinct if approximate else F.count_distinct
    return g.tags.groupBy("axis").agg(count("entity_id").alias("n")).join(F.broadcast(total)).select("axis", "n", micro(c("n") * 100.0 / c("total")).alias("pct6"))


@query("agg_conditional", "SELECT entity_type, count(*) AS n, count(lat) AS with_place, count(release_year) AS with_year, sum(is_dormant) AS dormant FROM entities GROUP BY entity_type")
def agg_conditional(g):
    return g.entities.groupBy("entity_type").agg(n_rows(), F.count_if(c("lat").isNotNull()).alias("with_place"), F.count_if(c("release_year").isNotNull()).alias("with_year"), F.sum("is_dormant").alias("dormant"))


@query(
    "agg_pilgrimage_coverage",
    "SELECT count(DISTINCT CASE WHEN e.entity_type = 'place' AND e.lat IS NOT NULL THEN e.id END) AS places, count(DISTINCT CASE WHEN e.entity_type = 'work' THEN e.id END) AS works FROM sym s JOIN entities e ON e.id = s.node WHERE s.connection_type LIKE 'pilgrimage%'",
)
def agg_pilgrimage_coverage(g):
    nodes = both_ways(g.edges.where(c("connection_type").startswith("pilgrimage"))).select("node").distinct()
    e = g.entities.join(nodes, c("id") == c("node"), "left_semi")
    return e.agg(F.count_if((c("entity_type") == "place") & c("lat").isNotNull()).alias("places"), F.count_if(c("entity_type") == "work").alias("works"))


#: Categories by words of the label.
CATEGORIES = {"metal": ("steel", "tin", "copper", "nickel", "brass"), "colour": ("red", "blue", "green", "white"), "article": ("the", "der", "les"), "person": ("customer",), "place": ("supplier",)}


@query(
    "agg_multi_predicate",
    "SELECT category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS category FROM entities WHERE " + " OR ".join(f"contains(lower(label), '{w}')" for w in ws) for k, ws in CATEGORIES.items()) + ") t GROUP BY category",
)
def agg_multi_predicate(g):
    """One pass: each label is exploded to the categories that it matches."""
    hit = lambda k, ws: F.when(c("l").rlike("|".join(ws)), k)
    found = g.entities.select(F.lower("label").alias("l")).select(F.explode(F.array_compact(F.array(*[hit(k, ws) for k, ws in CATEGORIES.items()]))).alias("category"))
    return found.groupBy("category").agg(n_rows())


@query("agg_having", "SELECT source, count(*) AS n FROM entities GROUP BY source HAVING count(*) BETWEEN 50 AND 10000")
def agg_having(g, low=50, high=10000):
    return g.entities.groupBy("source").agg(n_rows()).where(c("n").between(low, high))


@query("agg_having_distinct", "SELECT value_code, count(DISTINCT entity_type) AS kinds FROM entity_tags JOIN entities ON id = entity_id GROUP BY value_code HAVING count(DISTINCT entity_type) >= 2")
def agg_having_distinct(g):
    kinds = g.tags.join(g.entities.select("id", "entity_type"), c("entity_id") == c("id"))
    return kinds.groupBy("value_code").agg(F.count_distinct("entity_type").alias("kinds")).where("kinds >= 2")


@query("agg_string_agg", "SELECT entity_id, string_agg(v, ',' ORDER BY v) AS tags FROM (SELECT DISTINCT entity_id, axis || ':' || value_code AS v, axis FROM entity_tags) t GROUP BY entity_id HAVING count(DISTINCT axis) >= 2")
def agg_string_agg(g):
    named = F.concat_ws(":", "axis", "value_code")
    return g.tags.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(named)), ",").alias("tags"), F.count_distinct("axis").alias("k")).where("k >= 2").select("entity_id", "tags")


def tag_map(tags):
    """entity_id -> tags: map of axis to its sorted values."""
    values = tags.groupBy("entity_id", "axis").agg(F.array_sort(F.collect_set("value_code")).alias("v"))
    return values.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "v")))).alias("tags"))


@query("agg_tag_map", "SELECT entity_id, string_agg(axis || '=' || v, ';' ORDER BY axis) AS tags FROM (SELECT entity_id, axis, string_agg(DISTINCT value_code, '+' ORDER BY value_code) AS v FROM entity_tags GROUP BY entity_id, axis) t GROUP BY entity_id")
def agg_tag_map(g):
    shown = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "+")))
    return tag_map(g.tags).select("entity_id", F.array_join(shown, ";").alias("tags"))


@query(
    "agg_ratio_density",
    f"SELECT {micro_sql('(SELECT count(*) FROM connections) / CAST(count(*) AS DOUBLE)')} AS density6, {micro_sql('(SELECT count(*) FROM connections WHERE verdict = ' + chr(39) + 'keep' + chr(39) + ') / CAST((SELECT count(*) FROM connections) AS DOUBLE)')} AS keep6, {micro_sql('count(label_en) / CAST(count(*) AS DOUBLE)')} AS english6 FROM entities",
)
def agg_ratio_density(g):
    e = g.entities.agg(F.count("*").alias("ne"), F.count("label_en").alias("nl"))
    k = g.edges.agg(F.count("*").alias("nk"), F.count_if(c("verdict") == "keep").alias("kept"))
    return e.join(F.broadcast(k)).select(micro(c("nk") / c("ne")).alias("density6"), micro(c("kept") / c("nk")).alias("keep6"), micro(c("nl") / c("ne")).alias("english6"))


def shares(df, key):
    """Share of each key's rows in all rows."""
    per = df.groupBy(key).agg(n_rows())
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select(key, (c("n") / c("total")).alias("p"))


_SHARES = "WITH p AS (SELECT count(*) / CAST((SELECT count(*) FROM {0}) AS DOUBLE) AS p FROM {0} GROUP BY {1}) "


@query("agg_entropy", _SHARES.format("entities", "entity_type") + "SELECT CAST(floor(-sum(p * ln(p)) * 1000 + 0.5) AS BIGINT) AS entropy3 FROM p")
def agg_entropy(g):
    return shares(g.entities, "entity_type").agg(F.floor(-F.sum(c("p") * F.log("p")) * 1000 + 0.5).cast("long").alias("entropy3"))


@query("agg_hhi", _SHARES.format("(SELECT * FROM entity_tags WHERE axis = 'theme')", "value_code") + f"SELECT {micro_sql('sum(p * p)')} AS hhi6, {micro_sql('max(p)')} AS top6 FROM p")
def agg_hhi(g):
    return shares(g.tags.where("axis = 'theme'"), "value_code").agg(micro(F.sum(c("p") * c("p"))).alias("hhi6"), micro(F.max("p")).alias("top6"))


_CELL = "CAST(floor(lat * 5) AS BIGINT) AS cy, CAST(floor(lon * 5) AS BIGINT) AS cx"


@query("agg_mode_per_group", f"SELECT cy, cx, entity_type, n FROM (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY n DESC, entity_type) AS rn FROM (SELECT {_CELL}, entity_type, count(*) AS n FROM entities WHERE lat IS NOT NULL GROUP BY 1, 2, 3) t) u WHERE rn = 1")
def agg_mode_per_group(g):
    per = g.entities.where("lat is not null").groupBy(F.floor(c("lat") * 5).alias("cy"), F.floor(c("lon") * 5).alias("cx"), "entity_type").agg(n_rows())
    best = F.min(F.struct((-c("n")).alias("m"), "entity_type"))
    return per.groupBy("cy", "cx").agg(best.alias("b")).select("cy", "cx", "b.entity_type", (-c("b.m")).alias("n"))


@query("agg_histogram_decade", "SELECT CAST(floor(release_year / 10.0) * 10 AS BIGINT) AS decade, count(*) AS n FROM entities WHERE release_year IS NOT NULL GROUP BY 1")
def agg_histogram_decade(g):
    return g.entities.where("release_year is not null").groupBy((F.floor(c("release_year") / 10) * 10).alias("decade")).agg(n_rows())


@query("agg_two_key_breakdown", "SELECT source, entity_type, count(*) AS n FROM entities GROUP BY source, entity_type")
def agg_two_key_breakdown(g):
    return g.entities.groupBy("source", "entity_type").agg(n_rows())


@query("agg_outlier_counts", "SELECT count(*) FILTER (WHERE release_year < 1700) AS early, count(*) FILTER (WHERE release_year > 2000) AS late, count(*) FILTER (WHERE release_year IS NULL) AS missing FROM entities")
def agg_outlier_counts(g, low=1700, high=2000):
    y = c("release_year")
    return g.entities.agg(F.count_if(y < low).alias("early"), F.count_if(y > high).alias("late"), F.count_if(y.isNull()).alias("missing"))


@query(
    "agg_latency_stats",
    f"""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, {micro_sql('avg(value)')} AS mean6, {micro_sql('quantile_cont(value, 0.5)')} AS median6, {micro_sql('max(value) FILTER (WHERE i = CAST(floor(0.95 * n) AS BIGINT))')} AS p95_6, {micro_sql('min(value)')} AS min6, {micro_sql('max(value)')} AS max6 FROM s GROUP BY event_type, n""",
)
def agg_latency_stats(g):
    """Mean, median, p95 (the sample at floor(0.95 n)), least and most. Ranks come from counts of equal values, so no group is collected."""
    from pyspark.sql import Window

    per = g.table("events").where("value is not null").groupBy("event_type", "value").agg(n_rows())
    upto = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("event_type"))})
    holds = lambda at: (c("upto") > at) & (c("upto") - c("n") <= at)
    taken = lambda at: F.max(F.when(holds(at), c("value")))
    middle = (taken(F.floor((c("total") - 1) / 2)) + taken(F.floor(c("total") / 2))) / 2
    basic = g.table("events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    p95 = ranked.groupBy("event_type").agg(taken(F.floor(c("total") * 0.95)).alias("p95"), middle.alias("median"))
    return basic.join(p95, "event_type").select("event_type", "n", micro(c("mean")).alias("mean6"), micro(c("median")).alias("median6"), micro(c("p95")).alias("p95_6"), micro(c("low")).alias("min6"), micro(c("high")).alias("max6"))


@query(
    "agg_score_dims",
    """SELECT connection_type, source, count(*) AS n, CAST(floor(sum(score) * 1000 + 0.5) AS BIGINT) AS total3, count(*) FILTER (WHERE score < 0.3) AS low, count(*) FILTER (WHERE score >= 0.3 AND score < 0.5) AS mid, count(*) FILTER (WHERE score >= 0.5) AS high FROM connections GROUP BY connection_type, source""",
)
def agg_score_dims(g):
    s = c("score")
    return g.edges.groupBy("connection_type", "source").agg(n_rows(), F.floor(F.sum(s) * 1000 + 0.5).cast("long").alias("total3"), F.count_if(s < 0.3).alias("low"), F.count_if((s >= 0.3) & (s < 0.5)).alias("mid"), F.count_if(s >= 0.5).alias("high"))


@query("agg_coverage_matrix", "SELECT value_code, count(*) FILTER (WHERE entity_type = 'person') AS person, count(*) FILTER (WHERE entity_type = 'place') AS place, count(*) FILTER (WHERE entity_type = 'work') AS work, count(*) FILTER (WHERE entity_type = 'artifact') AS artifact, count(*) AS total FROM entity_tags JOIN entities ON id = entity_id GROUP BY value_code")
def agg_coverage_matrix(g):
    kinds = ["person", "place", "work", "artifact"]
    wide = g.tags.join(g.entities.select("id", "entity_type"), c("entity_id") == c("id")).groupBy("value_code").pivot("entity_type", kinds).count()
    filled = [F.coalesce(c(k), F.lit(0)) for k in kinds]
    return wide.select("value_code", *[f.alias(k) for f, k in zip(filled, kinds, strict=True)], sum(filled[1:], filled[0]).alias("total"))


# ---- graph health


@query(
    "job_graph_health",
    f"""WITH linked AS (SELECT DISTINCT node FROM sym) SELECT count(*) AS entities, count(l.node) AS linked, count(*) - count(l.node) AS isolated, count(*) FILTER (WHERE is_dormant = 0) AS active,
{micro_sql('(SELECT count(*) FROM connections) / CAST(count(*) AS DOUBLE)')} AS density6, {micro_sql('2.0 * (SELECT count(*) FROM connections) / count(*) FILTER (WHERE is_dormant = 0)')} AS active_density6, count(l.node) * 2 >= count(*) AS passed FROM entities e LEFT JOIN linked l ON l.node = e.id""",
)
def job_graph_health(g):
    linked = g.both_ways.select("node").distinct()
    e = g.entities.join(linked, c("id") == c("node"), "left").agg(F.count("*").alias("entities"), F.count("node").alias("linked"), F.count_if(c("is_dormant") == 0).alias("active"))
    k = g.edges.agg(F.count("*").alias("k"))
    return e.join(F.broadcast(k)).select("entities", "linked", (c("entities") - c("linked")).alias("isolated"), "active", micro(c("k") / c("entities")).alias("density6"), micro(2.0 * c("k") / c("active")).alias("active_density6"), (c("linked") * 2 >= c("entities")).alias("passed"))


@query(
    "job_coverage_report",
    "SELECT 'type' AS part, entity_type AS key, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'axis', axis, count(*) FROM entity_tags GROUP BY 2 UNION ALL SELECT 'edge', connection_type, count(*) FROM connections GROUP BY 2",
)
def job_coverage_report(g):
    part = lambda df, name, key: df.groupBy(c(key).alias("key")).agg(n_rows()).select(F.lit(name).alias("part"), "key", "n")
    return part(g.entities, "type", "entity_type").unionByName(part(g.entities, "source", "source")).unionByName(part(g.tags, "axis", "axis")).unionByName(part(g.edges, "edge", "connection_type"))


def _stats_sql():
    count = lambda part, key, source: f"SELECT '{part}' AS part, {key} AS key, count(*) AS n FROM {source} GROUP BY 2"
    top = lambda part, key, source, n=20: f"SELECT * FROM ({count(part, key, source)} ORDER BY n DESC, key LIMIT {n})"
    return " UNION ALL ".join([
        "SELECT 'total' AS part, 'entities' AS key, count(*) AS n FROM entities", "SELECT 'total', 'tags', count(*) FROM entity_tags", "SELECT 'total', 'edges', count(*) FROM connections",
        "SELECT 'coverage', 'tagged', count(DISTINCT entity_id) FROM entity_tags", "SELECT 'coverage', 'placed', count(lat) FROM entities", "SELECT 'coverage', 'dated', count(release_year) FROM entities", "SELECT 'coverage', 'linked', count(DISTINCT node) FROM sym",
        top("type", "entity_type", "entities"), top("source", "source", "entities"), top("axis", "axis", "entity_tags"), top("edge", "connection_type || '/' || verdict", "connections"),
    ])


@query("q_stats", _stats_sql())
def q_stats(g, n=20):
    """Totals, coverage, and the most frequent types, sources, axes and kinds of edges."""
    row = lambda df, part, key, value: df.agg(value.alias("n")).select(F.lit(part).alias("part"), F.lit(key).alias("key"), "n")
    top = lambda df, part, key: df.groupBy(key.alias("key")).agg(n_rows()).orderBy(F.desc("n"), "key").limit(n).select(F.lit(part).alias("part"), "key", "n")
    all_ = F.count("*")
    parts = [
        row(g.entities, "total", "entities", all_), row(g.tags, "total", "tags", all_), row(g.edges, "total", "edges", all_),
        row(g.tags, "coverage", "tagged", F.count_distinct("entity_id")), row(g.entities, "coverage", "placed", F.count("lat")), row(g.entities, "coverage", "dated", F.count("release_year")), row(g.both_ways, "coverage", "linked", F.count_distinct("node")),
        top(g.entities, "type", c("entity_type")), top(g.entities, "source", c("source")), top(g.tags, "axis", c("axis")), top(g.edges, "edge", F.concat_ws("/", "connection_type", "verdict")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "src_property_group",
    "SELECT axis, string_agg(DISTINCT value_code, ',' ORDER BY value_code) AS vals FROM entity_tags GROUP BY axis",
)
def src_property_group(g):
    """Distinct values by property; properties are few, and so are the values of each."""
    return g.tags.groupBy("axis").agg(F.array_join(F.array_sort(F.collect_set("value_code")), ",").alias("vals"))


@query("src_statcount", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def src_statcount(g):
    return g.table("events").groupBy("event_type").agg(n_rows())


@query("text_source_summary", f"SELECT source, count(*) AS total, count(*) FILTER (WHERE is_dormant = 0) AS ok, {micro_sql('count(*) FILTER (WHERE is_dormant = 0) / CAST(count(*) AS DOUBLE)')} AS rate6 FROM entities GROUP BY source")
def text_source_summary(g):
    return g.entities.groupBy("source").agg(F.count("*").alias("total"), F.count_if(c("is_dormant") == 0).alias("ok")).withColumn("rate6", micro(c("ok") / c("total")))


@query(
    "job_scenario_score",
    "SELECT p_brand AS keyword, count(*) AS hits, count(s.other) AS edges, CASE WHEN count(s.other) >= 50 THEN 5 WHEN count(s.other) >= 20 THEN 4 WHEN count(s.other) >= 5 THEN 3 WHEN count(*) > 0 THEN 2 ELSE 1 END AS grade FROM part LEFT JOIN sym s ON s.node = 3000000000000 + p_partkey AND s.verdict = 'keep' GROUP BY p_brand",
)
def job_scenario_score(g):
    """A search-quality grade for each keyword, from its hits and their kept edges."""
    hits = g.table("part").select(c("p_brand").alias("keyword"), (3_000_000_000_000 + c("p_partkey")).alias("id"))
    found = hits.join(both_ways(g.kept).select("node", "other"), c("id") == c("node"), "left").groupBy("keyword").agg(F.count("*").alias("hits"), F.count("other").alias("edges"))
    e = c("edges")
    return found.withColumn("grade", F.when(e >= 50, 5).when(e >= 20, 4).when(e >= 5, 3).when(c("hits") > 0, 2).otherwise(1))


@query("win_rank_list", "SELECT value_code AS region, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM entity_tags WHERE axis = 'geography' GROUP BY value_code")
def win_rank_list(g):
    from pyspark.sql import Window

    per = g.tags.where("axis = 'geography'").groupBy(c("value_code").alias("region")).agg(n_rows())
    return per.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))


@query("win_first_seen", "SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM entities) t WHERE rn = 1")
def win_first_seen(g):
    return g.entities.groupBy("label").agg(F.min("id").alias("id"))


__all__ = ["first_per", "micro", "micro_sql", "shares", "tag_map"]
