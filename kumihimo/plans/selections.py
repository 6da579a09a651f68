"""Scans, filters, projections, sorts, samples and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..model import degree_box
from .registry import query

c = F.col


@query("scan_entities", "SELECT id, label, entity_type, source FROM entities")
def scan_entities(g):
    return g.entities.select("id", "label", "entity_type", "source")


@query("scan_tags", "SELECT entity_id, axis, value_code FROM entity_tags")
def scan_tags(g):
    return g.tags.select("entity_id", "axis", "value_code")


@query("scan_edges", "SELECT a_id, b_id, connection_type FROM connections")
def scan_edges(g):
    return g.edges.select("a_id", "b_id", "connection_type")


@query("filt_label_contains", "SELECT id, label FROM entities WHERE label ILIKE '%and%'")
def filt_label_contains(g, keyword="and"):
    return g.entities.where(c("label").ilike(f"%{keyword}%")).select("id", "label")


@query(
    "filt_conjunct_dynamic",
    "SELECT id, entity_type FROM entities WHERE (label ILIKE '%the%' OR label_en ILIKE '%the%') AND (entity_type = 'artifact' OR entity_type = 'work') AND is_dormant = 0",
)
def filt_conjunct_dynamic(g, keyword="the", types=("artifact", "work"), active=True):
    """Optional conditions, all of which must hold; each may be a choice."""
    conditions = []
    if keyword:
        conditions.append(F.coalesce(c("label").ilike(f"%{keyword}%"), F.lit(False)) | F.coalesce(c("label_en").ilike(f"%{keyword}%"), F.lit(False)))
    if types:
        conditions.append(c("entity_type").isin(*types))
    if active:
        conditions.append(c("is_dormant") == 0)
    return g.entities.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select("id", "entity_type")


_KYOTO = degree_box(35.0116, 135.7681, 30)


@query("filt_bbox", f"SELECT id FROM entities WHERE lat BETWEEN {_KYOTO[0]!r} AND {_KYOTO[1]!r} AND lon BETWEEN {_KYOTO[2]!r} AND {_KYOTO[3]!r}")
def filt_bbox(g, box=_KYOTO):
    return g.entities.where(c("lat").between(box[0], box[1]) & c("lon").between(box[2], box[3])).select("id")


@query("filt_has_tag", "SELECT id FROM entities WHERE id IN (SELECT entity_id FROM entity_tags WHERE axis = 'geography' AND value_code = 'ASIA')")
def filt_has_tag(g, axis="geography", value="ASIA"):
    tagged = g.tags.where((c("axis") == axis) & (c("value_code") == value))
    return g.entities.join(tagged, c("id") == c("entity_id"), "left_semi").select("id")


@query("filt_exists_tag", "SELECT id, label FROM entities e WHERE EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND t.axis = 'era')")
def filt_exists_tag(g, axis="era"):
    return g.entities.join(g.tags.where(c("axis") == axis), c("id") == c("entity_id"), "left_semi").select("id", "label")


@query("filt_exclude_ids", "SELECT id FROM entities WHERE id NOT IN (SELECT a_id FROM connections UNION SELECT b_id FROM connections)")
def filt_exclude_ids(g):
    return g.entities.join(g.both_ways.select("node"), c("id") == c("node"), "left_anti").select("id")


@query("filt_type_prefix", "SELECT a_id, b_id FROM connections WHERE connection_type LIKE 'pilgrimage%'")
def filt_type_prefix(g, prefix="pilgrimage"):
    return g.edges.where(c("connection_type").startswith(prefix)).select("a_id", "b_id")


@query("filt_year_range", "SELECT id, release_year FROM entities WHERE release_year >= 1850 AND release_year <= 1900")
def filt_year_range(g, low=1850, high=1900):
    found = g.entities
    if low is not None:
        found = found.where(c("release_year") >= low)
    if high is not None:
        found = found.where(c("release_year") <= high)
    return found.select("id", "release_year")


@query("filt_untagged", "SELECT id FROM entities e LEFT JOIN (SELECT DISTINCT entity_id FROM entity_tags WHERE axis IN ('theme', 'geography')) t ON e.id = t.entity_id WHERE t.entity_id IS NULL")
def filt_untagged(g):
    return g.entities.join(g.tags.where(c("axis").isin("theme", "geography")), c("id") == c("entity_id"), "left_anti").select("id")


@query("filt_only_value", "SELECT entity_id FROM entity_tags WHERE axis = 'medium' GROUP BY entity_id HAVING bool_and(value_code = 'en')")
def filt_only_value(g, axis="medium", value="en"):
    return g.tags.where(c("axis") == axis).groupBy("entity_id").agg(F.bool_and(c("value_code") == value).alias("only")).where("only").select("entity_id")


@query("filt_label_quality", "SELECT id, label FROM entities WHERE length(label) BETWEEN 2 AND 300 AND NOT regexp_matches(label, '^Q[0-9]+$')")
def filt_label_quality(g):
    return g.entities.where(F.length("label").between(2, 300) & ~c("label").rlike("^Q[0-9]+$")).select("id", "label")


@query("filt_country_box", "SELECT id, lat, lon FROM entities WHERE lat BETWEEN 24 AND 46 AND lon BETWEEN 122 AND 154")
def filt_country_box(g):
    return g.entities.where(c("lat").between(24, 46) & c("lon").between(122, 154)).select("id", "lat", "lon")


@query("proj_case_priority", "SELECT a_id, b_id, CASE WHEN source = 'lineitem' THEN 0 ELSE 1 END AS priority FROM connections")
def proj_case_priority(g, first="lineitem"):
    return g.edges.select("a_id", "b_id", F.when(c("source") == first, 0).otherwise(1).alias("priority"))


@query("proj_other_endpoint", "SELECT CASE WHEN a_id = 2000001 THEN b_id ELSE a_id END AS other, score FROM connections WHERE a_id = 2000001 OR b_id = 2000001")
def proj_other_endpoint(g, node=2000001):
    return g.both_ways.where(c("node") == node).select("other", "score")


@query("proj_coalesce_unknown", "SELECT id, coalesce(label_en, 'unknown') AS label_en, coalesce(CAST(release_year AS VARCHAR), 'unknown') AS year FROM entities")
def proj_coalesce_unknown(g):
    unknown = F.lit("unknown")
    return g.entities.select("id", F.coalesce("label_en", unknown).alias("label_en"), F.coalesce(c("release_year").cast("string"), unknown).alias("year"))


# ---- sorts, limits, samples


@query("sort_topk_distance", "SELECT id FROM entities WHERE lat IS NOT NULL ORDER BY floor((abs(lat - 35.0) + abs(lon - 136.0)) * 1e6 + 0.5), id LIMIT 50")
def sort_topk_distance(g, lat=35.0, lon=136.0, n=50):
    away = F.floor((F.abs(c("lat") - lat) + F.abs(c("lon") - lon)) * 1e6 + 0.5)
    return g.entities.where("lat is not null").orderBy(away, "id").limit(n).select("id")


@query("sort_multi_key", "SELECT a_id, b_id, score FROM connections WHERE verdict = 'keep' ORDER BY CASE WHEN source = 'orders' THEN 0 ELSE 1 END, score DESC, a_id, b_id LIMIT 200")
def sort_multi_key(g, n=200):
    return g.kept.orderBy(F.when(c("source") == "orders", 0).otherwise(1), F.desc("score"), "a_id", "b_id").limit(n).select("a_id", "b_id", "score")


@query(
    "sort_then_resort",
    "SELECT id, row_number() OVER (ORDER BY floor((abs(lat - 35.0) + abs(lon - 136.0)) * 1e6 + 0.5), id) AS pos FROM (SELECT * FROM entities WHERE lat IS NOT NULL ORDER BY label, id LIMIT 100) t",
)
def sort_then_resort(g, lat=35.0, lon=136.0, n=100):
    """The first n by label, then ordered by distance (not the nearest n; sort_topk_distance gives those)."""
    from pyspark.sql import Window

    away = F.floor((F.abs(c("lat") - lat) + F.abs(c("lon") - lon)) * 1e6 + 0.5)
    first = g.entities.where("lat is not null").orderBy("label", "id").limit(n)
    return first.select("id", F.row_number().over(Window.orderBy(away, "id")).cast("long").alias("pos"))


def clamp(value: float, low: float, high: float) -> float:
    """An argument within its documented bounds."""
    return max(low, min(high, value))


@query("limit_clamp", "SELECT id FROM entities ORDER BY id LIMIT 100")
def limit_clamp(g, n=5000):
    return g.entities.orderBy("id").limit(int(clamp(n, 1, 100))).select("id")


@query("sample_hash_pct", "SELECT id FROM entities WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 4 = 0")
def sample_hash_pct(g, one_in=4):
    return g.entities.where(F.conv(F.substring(F.md5(c("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % one_in == 0).select("id")


@query("sample_seeded", "SELECT id FROM entities ORDER BY md5('seed-' || CAST(id AS VARCHAR)), id LIMIT 300")
def sample_seeded(g, n=300, seed="seed-"):
    return g.entities.orderBy(F.md5(F.concat(F.lit(seed), c("id").cast("string")).cast("binary")), "id").limit(n).select("id")


# ---- set operations


@query("set_union_distinct", "SELECT a_id AS id FROM connections UNION SELECT b_id FROM connections")
def set_union_distinct(g):
    return g.edges.select(c("a_id").alias("id")).unionByName(g.edges.select(c("b_id").alias("id"))).distinct()


@query("set_union_ids", "SELECT id FROM entities WHERE id IN (SELECT b_id FROM connections WHERE connection_type = 'creator_work' UNION SELECT a_id FROM connections WHERE connection_type = 'creator_work')")
def set_union_ids(g):
    made = g.both_ways.where("connection_type = 'creator_work'").select("node")
    return g.entities.join(made, c("id") == c("node"), "left_semi").select("id")


@query("set_union_all_counts", "SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'tags', count(*) FROM entity_tags")
def set_union_all_counts(g):
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count(g.entities, "entities").unionByName(count(g.tags, "tags"))


_NEAR = "SELECT other FROM sym WHERE node = {} AND verdict = 'keep'"


@query("set_intersect", f"{_NEAR.format(3000001)} INTERSECT {_NEAR.format(3000002)}")
def set_intersect(g, a=3000001, b=3000002):
    near = lambda n: g.both_ways.where((c("node") == n) & (c("verdict") == "keep")).select("other")
    return near(a).intersect(near(b))


@query("set_except", f"{_NEAR.format(3000001)} EXCEPT {_NEAR.format(3000002)}")
def set_except(g, a=3000001, b=3000002):
    near = lambda n: g.both_ways.where((c("node") == n) & (c("verdict") == "keep")).select("other")
    return near(a).subtract(near(b))


@query(
    "set_tag_diff",
    """WITH pairs AS (SELECT a_id, b_id FROM connections WHERE connection_type = 'pilgrimage_spot'),
ax AS (SELECT unnest(['theme', 'medium', 'era', 'geography', 'experience']) AS axis),
va AS (SELECT p.a_id, p.b_id, t.axis, t.value_code FROM pairs p JOIN entity_tags t ON t.entity_id = p.a_id),
vb AS (SELECT p.a_id, p.b_id, t.axis, t.value_code FROM pairs p JOIN entity_tags t ON t.entity_id = p.b_id),
j AS (SELECT coalesce(va.a_id, vb.a_id) AS a_id, coalesce(va.b_id, vb.b_id) AS b_id, coalesce(va.axis, vb.axis) AS axis,
      va.value_code AS x, vb.value_code AS y FROM va FULL JOIN vb ON va.a_id = vb.a_id AND va.b_id = vb.b_id AND va.axis = vb.axis AND va.value_code = vb.value_code)
SELECT axis, count(*) FILTER (WHERE x = y) AS shared, count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b FROM j GROUP BY axis""",
)
def set_tag_diff(g):
    """Values by axis that both ends of a pilgrimage edge have, or only one of them."""
    sets = g.tags.groupBy("entity_id", "axis").agg(F.collect_set("value_code").alias("v"))
    pairs = g.edges.where("connection_type = 'pilgrimage_spot'").select("a_id", "b_id")
    side = lambda end, name: pairs.join(sets, c(end) == c("entity_id")).select("a_id", "b_id", "axis", c("v").alias(name))
    none = F.array().cast("array<string>")
    both = side("a_id", "x").join(side("b_id", "y"), ["a_id", "b_id", "axis"], "full").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    size = lambda e: F.sum(F.size(e)).cast("long")
    return both.groupBy("axis").agg(size(F.array_intersect("x", "y")).alias("shared"), size(F.array_except("x", "y")).alias("only_a"), size(F.array_except("y", "x")).alias("only_b"))


@query(
    "set_pair_dedupe",
    """SELECT DISTINCT least(x, y) AS a_id, greatest(x, y) AS b_id FROM (
  SELECT 2000000000000 + ps.l_suppkey AS x, 1000000000000 + o.o_custkey AS y FROM lineitem ps JOIN orders o ON o.o_orderkey = ps.l_orderkey
  UNION ALL SELECT 3000000000000 + l_partkey, 2000000000000 + l_suppkey FROM lineitem) t
WHERE x <> y AND NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = least(x, y) AND k.b_id = greatest(x, y))""",
)
def set_pair_dedupe(g):
    """Candidate pairs in one order, each once, without those that exist."""
    line, orders = g.table("lineitem"), g.table("orders")
    made = line.join(orders, c("l_orderkey") == c("o_orderkey")).select((2_000_000_000_000 + c("l_suppkey")).alias("x"), (1_000_000_000_000 + c("o_custkey")).alias("y"))
    known = line.select((3_000_000_000_000 + c("l_partkey")).alias("x"), (2_000_000_000_000 + c("l_suppkey")).alias("y"))
    return new_pairs(made.unionByName(known), g.edges)


def new_pairs(candidates, edges, x="x", y="y", few=False):
    """(a_id, b_id) of candidates: least end first, no self pair, each once, none that ``edges`` has. ``few``: a rule limits the pairs to some for each value of a dictionary, so they go to the edges, which are not shuffled."""
    pairs = candidates.where(c(x) != c(y)).select(F.least(x, y).cast("long").alias("a_id"), F.greatest(x, y).cast("long").alias("b_id")).distinct()
    known = edges.select("a_id", "b_id")
    if few:
        known = known.join(F.broadcast(pairs), ["a_id", "b_id"], "left_semi")
    return pairs.join(known, ["a_id", "b_id"], "left_anti")
