"""Edge generators: candidates by a rule, least end first, each once, none that exists.

Where a rule links members of a group, the group is cut by row number or
linked to its next members before any pair is made, so a group's size never
enters squared. A rule that ranks first and drops existing pairs after may
give a node fewer new edges than a loop that consumes pairs one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distance, rules
from ..functions.geo import haversine_m
from ..sources.graph import first_per, nodes_of
from .aggregates import micro, micro_sql
from .joins import BLOCK, NEAR_SQL, place_distances, place_pairs
from .registry import query
from .selections import new_pairs
from .nearest import k_nearest, other_kind_first
from .windows import capped_pairs, hash_order, linked_to_next

c = F.col

#: Generators that users add: name -> function of (entities, tags, edges) to candidate pairs.
EXTRA: dict[str, Callable] = {}


def register_generator(name: str, function: Callable) -> None:
    """Make a generator of one's own part of ``registered_pairs``."""
    EXTRA[name] = function


def registered_pairs(g, names=None):
    """New pairs of the generators that users added (or of some of them): a_id, b_id, generator; each pair once for each generator, none that exists."""
    chosen = list(EXTRA) if names is None else list(names)
    out = g.spark.createDataFrame([], "a_id long, b_id long, generator string")
    for name in chosen:
        pairs = EXTRA[name](g.entities, g.tags, g.edges)
        x, y = (c(k).cast("long") for k in pairs.columns[:2])
        out = out.unionByName(new_pairs(pairs.select(x.alias("x"), y.alias("y")), g.edges).withColumn("generator", F.lit(name)))
    return out


def fresh(candidates: str, head: str = "") -> str:
    """SQL of the new pairs among candidates (x, y)."""
    return f"{head} SELECT DISTINCT least(x, y) AS a_id, greatest(x, y) AS b_id FROM ({candidates}) q WHERE x <> y AND NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = least(x, y) AND k.b_id = greatest(x, y))"


def tagged(g, axis):
    return g.tags.where(c("axis") == axis).select(c("entity_id").alias("id"), c("value_code").alias("v"))


def _tag_sql(axis):
    return f"(SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = '{axis}')"


_ISOLATED = "iso AS (SELECT * FROM entities e WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.node = e.id))"


def isolated(g):
    return g.entities.join(nodes_of(g.edges), c("id") == c("node"), "left_anti")


# ---- scored pairs


def pair_distances(g, pairs):
    """Five distances of pairs (a_id, b_id) of works, from their tag sets."""
    none = F.array().cast("array<string>")
    sets = g.tags.groupBy("entity_id").pivot("axis", ["theme", "era", "medium", "geography", "experience"]).agg(F.array_sort(F.collect_set("value_code")))
    axes = [x for x in sets.columns if x != "entity_id"]
    for end, p in (("a_id", "a"), ("b_id", "b")):
        pairs = pairs.join(sets.select(c("entity_id").alias(end), *[c(x).alias(f"{p}_{x}") for x in axes]), end, "left")
    side = lambda x: (F.coalesce(f"a_{x}", none), F.coalesce(f"b_{x}", none))
    out = {"td": distance.jaccard_distance(*side("theme")), "ed": distance.era_distance(*side("era")), "md": distance.jaccard_distance(*side("medium")), "gd": distance.jaccard_distance(*side("geography")), "xd": distance.jaccard_distance(*side("experience"))}
    return pairs.select("a_id", "b_id", *[v.alias(k) for k, v in out.items()])


def theme_groups(g, most=200, ancestors=True):
    """Pairs (a_id, b_id) of works that share a theme, or an ancestor of their themes; of a group beyond ``most`` members the ``most`` first by hash take part, as its rule says."""
    from .functions import theme_parents

    members = tagged(g, "theme")
    if ancestors:
        up = F.broadcast(distance.closure(theme_parents(g)).select(c("code").alias("v"), "ancestor"))  # a dictionary
        members = members.join(up, "v").select("id", c("ancestor").alias("v"))
    few = capped_pairs(members.distinct().withColumn("h", hash_order("theme")), ["v"], ["h", "id"], most)
    return few.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).where("a_id <> b_id").distinct()


_PAIR_SQL = """{tree}g0 AS ({members}), r AS (SELECT id, v, row_number() OVER (PARTITION BY v ORDER BY md5('theme' || CAST(id AS VARCHAR)), id) AS rn FROM (SELECT DISTINCT id, v FROM g0) d),
cp AS (SELECT DISTINCT least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id FROM r x JOIN r y ON x.v = y.v AND x.rn < y.rn AND y.rn <= 200),
tg AS (SELECT entity_id AS id, max(CASE WHEN axis = 'medium' THEN value_code END) AS medium, max(CASE WHEN axis = 'era' THEN value_code END) AS era, max(CASE WHEN axis = 'theme' THEN value_code END) AS theme FROM entity_tags GROUP BY 1),
dd AS (SELECT a_id, b_id, abs(ea - eb) / 8.0 AS ed, CASE WHEN ma = mb THEN 0.0 ELSE 1.0 END AS md, ta, tb FROM (
  SELECT cp.a_id, cp.b_id, x.medium AS ma, y.medium AS mb, x.theme AS ta, y.theme AS tb, {ea} AS ea, {eb} AS eb FROM cp JOIN tg x ON x.id = cp.a_id JOIN tg y ON y.id = cp.b_id) z)"""


def _pairs_sql(ancestors):
    from ..model import era_index
    from .functions import _TREE_SQL

    own = "SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = 'theme'"
    members = f"SELECT m.id, up.anc AS v FROM ({own}) m JOIN up ON up.code = m.v" if ancestors else own
    tree = _TREE_SQL + ", st AS (SELECT x.code AS a, y.code AS b, min(x.up + y.up) AS s FROM up x JOIN up y ON x.anc = y.anc GROUP BY 1, 2), " if ancestors else ""
    return _PAIR_SQL.format(tree=tree, members=members, ea=era_index("x.era"), eb=era_index("y.era"))


_NEW = "NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = dd.a_id AND k.b_id = dd.b_id)"


@query(
    "gen_theme_scored_v1",
    f"WITH {_pairs_sql(False)} SELECT a_id, b_id, {micro_sql('s')} AS score6 FROM (SELECT a_id, b_id, CASE WHEN ed > 0.3 THEN 1.2 * ed WHEN md > 0.5 THEN 1.1 * md WHEN ed < 0.2 AND md < 0.2 THEN 0.2 ELSE 0.3 END AS s FROM dd WHERE {_NEW} AND NOT (ed = 0 AND md = 0)) t WHERE s >= 0.3 ORDER BY floor(s * 1e6 + 0.5) DESC, a_id, b_id LIMIT 500",
)
def gen_theme_scored_v1(g, at=0.3, total=500):
    """Sharers of a theme by the first rule table, the best ``total`` of them; equal in medium and era they are left out."""
    pairs = theme_groups(g, ancestors=False)
    d = pair_distances(g, pairs.join(g.edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")).where(~((c("ed") == 0) & (c("md") == 0)))
    r = rules.score_rule_v1(F.lit(0.0), c("ed"), c("md"), F.lit(0.5))
    scored = d.select("a_id", "b_id", r["score"].alias("s")).where(c("s") >= at).select("a_id", "b_id", micro(c("s")).alias("score6"))
    return scored.orderBy(F.desc("score6"), "a_id", "b_id").limit(total)


@query(
    "gen_theme_scored_v2",
    f"""WITH {_pairs_sql(True)}, di AS (SELECT dd.*, CASE WHEN st.s IS NULL THEN 0.8 ELSE least(0.6, st.s * 0.2) END AS td FROM dd LEFT JOIN st ON st.a = ta AND st.b = tb),
sc AS (SELECT a_id, b_id, CASE WHEN td < 0.5 AND ed > 0.3 THEN 1.2 * (1 - td) * ed WHEN td < 0.5 AND md > 0.5 THEN 1.1 * (1 - td) * md WHEN td < 0.5 THEN (1 - td) * 0.5 WHEN td > 0.7 AND ed > 0.7 AND md > 0.7 THEN 0.05 ELSE 0.1 END AS s FROM di AS dd WHERE {_NEW}),
rk AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY floor(s * 1e6 + 0.5) DESC, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY floor(s * 1e6 + 0.5) DESC, a_id) AS rb FROM sc WHERE s >= 0.25)
SELECT a_id, b_id, {micro_sql('s')} AS score6 FROM rk WHERE ra <= 15 AND rb <= 15 ORDER BY floor(s * 1e6 + 0.5) DESC, a_id, b_id LIMIT 800""",
)
def gen_theme_scored_v2(g, quota=15, total=800):
    """Sharers of a theme or of an ancestor of theirs by the second rule table, with the distance of their themes in the tree, and with quotas of each end and of the total, as ranks."""
    from .functions import theme_parents

    pairs = theme_groups(g)
    d = pair_distances(g, pairs.join(g.edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")).drop("td")
    theme = tagged(g, "theme").groupBy("id").agg(F.max("v").alias("v"))
    for end, name in (("a_id", "a"), ("b_id", "b")):
        d = d.join(theme.select(c("id").alias(end), c("v").alias(name)), end)
    steps = F.broadcast(distance.tree_distance(theme_parents(g)))  # a dictionary
    d = d.join(steps, ["a", "b"], "left").withColumn("td", distance.theme_distance(c("steps"), F.lit(False)))
    same = F.lit("work")
    s = rules.score_rule_v2(c("td"), c("ed"), c("md"), c("gd"), c("xd"), same, same)["score"]
    scored = d.select("a_id", "b_id", micro(s).alias("score6")).where("score6 >= 250000")
    ranked = first_per(first_per(scored, ["a_id"], [F.desc("score6"), "b_id"], "ra"), ["b_id"], [F.desc("score6"), "a_id"], "rb")
    return ranked.where((c("ra") <= quota) & (c("rb") <= quota)).orderBy(F.desc("score6"), "a_id", "b_id").limit(total).select("a_id", "b_id", "score6")


def capped_cross(left, right, group, n_left, n_right):
    """The first n_left x n_right of each group: (x, y)."""
    a = first_per(left, [group], ["id"]).where(c("rn") <= n_left).select(group, c("id").alias("x"))
    b = first_per(right, [group], ["id"]).where(c("rn") <= n_right).select(group, c("id").alias("y"))
    return a.join(b, group).select("x", "y")


def _cross_sql(left, right, group, n_left, n_right):
    top = lambda s, n: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY id) AS rn FROM {s} s) z WHERE rn <= {n})"
    return f"SELECT a.id AS x, b.id AS y FROM {top(left, n_left)} a JOIN {top(right, n_right)} b ON a.{group} = b.{group}"


_GEO = "(SELECT t.entity_id AS id, t.value_code AS v, e.entity_type FROM entity_tags t JOIN entities e ON e.id = t.entity_id WHERE axis = 'geography' AND entity_type = '{}')"


def _geo(g, kind):
    return tagged(g, "geography").join(g.entities.where(c("entity_type") == kind).select("id"), "id")


@query("gen_person_place_geo", fresh(_cross_sql(_GEO.format("person"), _GEO.format("place"), "v", 20, 10)))
def gen_person_place_geo(g):
    return new_pairs(capped_cross(_geo(g, "person"), _geo(g, "place"), "v", 20, 10), g.edges, few=True)


_MEMBER = "(SELECT entity_id AS id, substr(value_code, 1, 5) AS v FROM entity_tags WHERE axis = '{}')"


@query("gen_person_work_theme", fresh(_cross_sql(_MEMBER.format("experience"), "(SELECT 3000000000000 + p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'AUTOM' WHEN 1 THEN 'BUILD' WHEN 2 THEN 'FURNI' WHEN 3 THEN 'HOUSE' ELSE 'MACHI' END AS v FROM part)", "v", 10, 5)))
def gen_person_work_theme(g):
    """Persons and works of one field, ten by five of each."""
    people = tagged(g, "experience").withColumn("v", F.substring("v", 1, 5))
    field = F.element_at(F.array(*map(F.lit, ["AUTOM", "BUILD", "FURNI", "HOUSE", "MACHI"])), (c("p_size") % 5 + 1).cast("int"))
    works = g.table("part").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("id"), field.alias("v"))
    return new_pairs(capped_cross(people, works, "v", 10, 5), g.edges)


@query(
    "gen_rule_candidates",
    f"""WITH r AS (SELECT t.id, t.v, row_number() OVER (PARTITION BY t.v ORDER BY md5('rule' || CAST(t.id AS VARCHAR)), t.id) AS rn FROM {_tag_sql('theme')} t),
m AS (SELECT entity_id AS id, max(CASE WHEN axis = 'medium' THEN value_code END) AS medium, max(CASE WHEN axis = 'era' THEN value_code END) AS era FROM entity_tags GROUP BY 1)
SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, max(CASE WHEN x.medium <> y.medium AND x.era <> y.era THEN 70 WHEN x.medium <> y.medium THEN 65 ELSE 60 END) AS score100 FROM r a JOIN r b ON a.v = b.v AND b.rn BETWEEN a.rn + 1 AND a.rn + 19
JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id WHERE (x.medium <> y.medium OR x.era <> y.era) AND NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = least(a.id, b.id) AND k.b_id = greatest(a.id, b.id)) GROUP BY 1, 2""",
)
def gen_rule_candidates(g, span=19):
    """Theme sharers at most ``span`` apart in a seeded order, that differ in medium or era; medium and era go with the members, so no pair is joined with tags."""
    value = lambda axis: F.when(c("axis") == axis, c("value_code"))
    each = g.tags.groupBy(c("entity_id").alias("id")).agg(F.max(value("medium")).alias("m"), F.max(value("era")).alias("e"), F.collect_list(value("theme")).alias("v"))
    members = each.select("id", "m", "e", F.explode("v").alias("v")).withColumn("h", hash_order("rule"))
    pairs = linked_to_next(members, ["v"], ["h", "id"], span, both=("m", "e"))
    media, eras = c("xm") != c("ym"), c("xe") != c("ye")
    scored = pairs.where(media | eras).select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), F.when(media & eras, 70).when(media, 65).otherwise(60).alias("s"))
    return scored.groupBy("a_id", "b_id").agg(F.max("s").alias("score100")).join(g.edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")


def zipped(left, right, group, n, seed="z"):
    """The i-th of each group's left members with the i-th of its right ones, n at most, in a seeded order: (x, y)."""
    top = lambda df, name: first_per(df.withColumn("h", hash_order(seed)), [group], ["h", "id"]).where(c("rn") <= n).select(group, "rn", c("id").alias(name))
    return top(left, "x").join(top(right, "y"), [group, "rn"]).select("x", "y")


def _zip_sql(left, right, group, n, seed="z"):
    top = lambda s: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}' || CAST(id AS VARCHAR)), id) AS rn FROM {s} s) w WHERE rn <= {n})"
    return f"SELECT a.id AS x, b.id AS y FROM {top(left)} a JOIN {top(right)} b ON a.{group} = b.{group} AND a.rn = b.rn"


def by_pairs(df, dim, group, value, n, seed):
    """zipped() over a dictionary of value pairs (p, q) within each group: members of p with members of q."""
    side = lambda end: dim.join(df.select("id", *group, c(value).alias(end)), end).withColumn("grp", F.concat_ws("|", *group, "p", "q")).select("grp", "id")
    return zipped(side("p"), side("q"), "grp", n, seed)


def _by_pairs_sql(source, dim, group, value, n, seed):
    key = "concat_ws('|', " + ", ".join([*group, "p", "q"]) + ")"
    side = lambda end: f"(SELECT {key} AS grp, s.id FROM {dim} d JOIN {source} s ON s.{value} = d.{end})"
    return _zip_sql(side("p"), side("q"), "grp", n, seed)


def _dim(g, pairs):
    return g.spark.createDataFrame(pairs, "p string, q string")


def _dim_sql(pairs):
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{q}')" for p, q in pairs) + ") v(p, q))"


THEME_PAIRS = [("ECONOMY", "PROMO"), ("ECONOMY", "STANDARD"), ("SMALL", "LARGE"), ("SMALL", "PROMO"), ("MEDIUM", "STANDARD")]
ERA_PAIRS = [("edo_early", "heisei"), ("edo_early", "reiwa"), ("edo_late", "showa_postwar"), ("edo_late", "heisei"), ("meiji_taisho", "heisei"), ("meiji_taisho", "reiwa"), ("showa_prewar", "heisei"), ("showa_prewar", "reiwa"), ("edo_early", "meiji_taisho")]
EXPERIENCE_PAIRS = [("AUTOMOBILE", "BUILDING"), ("BUILDING", "FURNITURE"), ("FURNITURE", "MACHINERY"), ("HOUSEHOLD", "AUTOMOBILE")]


@query("gen_theme_pair_rules", fresh(_by_pairs_sql(_tag_sql("theme"), _dim_sql(THEME_PAIRS), [], "v", 300, "tp")))
def gen_theme_pair_rules(g):
    return new_pairs(by_pairs(tagged(g, "theme"), _dim(g, THEME_PAIRS), [], "v", 300, "tp"), g.edges)


@query("gen_era_pairs", fresh(_by_pairs_sql(_tag_sql("era"), _dim_sql(ERA_PAIRS), [], "v", 200, "ep")))
def gen_era_pairs(g):
    return new_pairs(by_pairs(tagged(g, "era"), _dim(g, ERA_PAIRS), [], "v", 200, "ep"), g.edges)


@query("gen_experience_pairs", fresh(_by_pairs_sql(_tag_sql("experience"), _dim_sql(EXPERIENCE_PAIRS), [], "v", 2000, "xp")))
def gen_experience_pairs(g):
    return new_pairs(by_pairs(tagged(g, "experience"), _dim(g, EXPERIENCE_PAIRS), [], "v", 2000, "xp"), g.edges)


def _next_sql(source, group, k, order="id"):
    return f"SELECT a.id AS x, b.id AS y, a.w AS xw, b.w AS yw FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {source} s) a JOIN (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {source} s) b ON a.{group} = b.{group} AND b.rn BETWEEN a.rn + 1 AND a.rn + {k}"


_ERA_MEDIUM = "(SELECT e.entity_id AS id, e.value_code AS v, m.value_code AS w FROM entity_tags e JOIN entity_tags m ON m.entity_id = e.entity_id AND m.axis = 'medium' WHERE e.axis = 'era')"


@query("gen_same_era_cross_medium", fresh(f"SELECT x, y FROM ({_next_sql(_ERA_MEDIUM, 'v', 4)}) n WHERE xw <> yw"))
def gen_same_era_cross_medium(g):
    """Within an era, the next four whose medium differs."""
    m = tagged(g, "medium").withColumnRenamed("v", "w")
    return new_pairs(linked_to_next(tagged(g, "era").join(m, "id"), ["v"], ["id"], 4, both=("w",)).where("xw <> yw"), g.edges)


_GEO_EXP = "(SELECT e.entity_id AS id, e.value_code AS v, m.value_code AS w FROM entity_tags e JOIN entity_tags m ON m.entity_id = e.entity_id AND m.axis = 'experience' WHERE e.axis = 'geography')"


@query("gen_geo_cross_theme", fresh(f"SELECT x, y FROM ({_next_sql(_GEO_EXP, 'v', 4)}) n WHERE xw <> yw"))
def gen_geo_cross_theme(g):
    m = tagged(g, "experience").withColumnRenamed("v", "w")
    return new_pairs(linked_to_next(tagged(g, "geography").join(m, "id"), ["v"], ["id"], 4, both=("w",)).where("xw <> yw"), g.edges)


def _of_type(kind):
    return f"(SELECT id, source, CAST(floor(lat * 10) AS BIGINT) * 100000 + CAST(floor(lon * 10) AS BIGINT) AS cell FROM entities WHERE entity_type = '{kind}' AND lat IS NOT NULL)"


def _located(g, kind):
    return g.entities.where((c("entity_type") == kind) & c("lat").isNotNull()).select("id", "source", (F.floor(c("lat") * 10) * 100000 + F.floor(c("lon") * 10)).alias("cell"))


@query("gen_source_type_cross", fresh(_cross_sql(_of_type("person"), _of_type("artifact"), "cell", 10, 10)))
def gen_source_type_cross(g):
    """Type by type within a group, ten of each at most."""
    return new_pairs(capped_cross(_located(g, "person"), _located(g, "artifact"), "cell", 10, 10), g.edges)


_MEDIA = [("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#5", "Brand#6"), ("Brand#7", "Brand#8")]
_THEME_MEDIUM = "(SELECT e.entity_id AS id, e.value_code AS v, m.value_code AS w FROM entity_tags e JOIN entity_tags m ON m.entity_id = e.entity_id AND m.axis = 'medium' WHERE e.axis = '{}')"


@query("gen_cross_medium_zip", fresh(_by_pairs_sql(_THEME_MEDIUM.format("theme"), _dim_sql(_MEDIA), ["v"], "w", 20, "cm")))
def gen_cross_medium_zip(g):
    """Per theme and pair of media, at most 20 sampled pairs."""
    m = tagged(g, "theme").join(tagged(g, "medium").withColumnRenamed("v", "w"), "id")
    return new_pairs(by_pairs(m, _dim(g, _MEDIA), ["v"], "w", 20, "cm"), g.edges)


@query("gen_same_era_cross_source", fresh(_by_pairs_sql(_THEME_MEDIUM.format("era"), _dim_sql(_MEDIA), ["v"], "w", 15, "es")))
def gen_same_era_cross_source(g):
    m = tagged(g, "era").join(tagged(g, "medium").withColumnRenamed("v", "w"), "id")
    return new_pairs(by_pairs(m, _dim(g, _MEDIA), ["v"], "w", 15, "es"), g.edges)


@query("gen_region_cross_theme", fresh(_by_pairs_sql(_GEO_EXP, _dim_sql(EXPERIENCE_PAIRS), ["v"], "w", 10, "rt")))
def gen_region_cross_theme(g):
    m = tagged(g, "geography").join(tagged(g, "experience").withColumnRenamed("v", "w"), "id")
    return new_pairs(by_pairs(m, _dim(g, EXPERIENCE_PAIRS), ["v"], "w", 10, "rt"), g.edges, few=True)


_SOURCES = [("src0", "src1"), ("src2", "src3"), ("AUTOMOBILE", "src0"), ("supplier", "MACHINERY"), ("Brand#1", "src1")]
_SOURCE_SQL = "(SELECT id, source AS v FROM entities)"


@query("gen_random_cross_source", fresh(_by_pairs_sql(_SOURCE_SQL, _dim_sql(_SOURCES), [], "v", 100, "rs")))
def gen_random_cross_source(g):
    return new_pairs(by_pairs(g.entities.select("id", c("source").alias("v")), _dim(g, _SOURCES), [], "v", 100, "rs"), g.edges)


@query("gen_cross_source_boost", fresh(_by_pairs_sql(_SOURCE_SQL, _dim_sql(_SOURCES), [], "v", 300, "bs")))
def gen_cross_source_boost(g):
    return new_pairs(by_pairs(g.entities.select("id", c("source").alias("v")), _dim(g, _SOURCES), [], "v", 300, "bs"), g.edges)


@query(
    "gen_same_theme_sample",
    fresh(f"SELECT x, y FROM (SELECT id AS x, lead(id) OVER (PARTITION BY v ORDER BY h, id) AS y, row_number() OVER (PARTITION BY v ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY v) AS n FROM (SELECT *, md5('st' || CAST(id AS VARCHAR)) AS h FROM {_tag_sql('theme')} t) u) w WHERE n > 100 AND rn <= 500 AND y IS NOT NULL"),
)
def gen_same_theme_sample(g, least=100, most=500):
    """At most 500 pairs of neighbours in a seeded order, of each theme with more than 100 members."""
    t = tagged(g, "theme").withColumn("h", hash_order("st"))
    large = t.groupBy("v").agg(F.count("*").alias("n")).where(c("n") > least).select("v")
    # the rank limit stands before the lead, so a group leaves each task as its first rows alone
    few = first_per(t.join(large, "v"), ["v"], ["h", "id"]).where(c("rn") <= most + 1)
    w = Window.partitionBy("v").orderBy("rn")
    return new_pairs(few.withColumn("y", F.lead("id").over(w)).where((c("rn") <= most) & c("y").isNotNull()).select(c("id").alias("x"), "y"), g.edges)


# ---- proximity


def new_near(g, placed, pairs, close, block=BLOCK):
    """New pairs of entities at places that are close: placed (id, lat, lon, kind), pairs of places (a_lat, a_lon, b_lat, b_lon) in both orders, ``close`` the test that they passed; kinds differ, unless they are null.

    Edges between close places are left out of the blocks that make the pairs,
    so pairs are never shuffled.
    """
    placed = placed.dropDuplicates(["id"])
    at = lambda end: placed.select(c("id").alias(f"{end}_id"), *[c(x).alias(f"{end}_{x}") for x in ("lat", "lon")])
    linked = g.edges.select("a_id", "b_id").join(at("a"), "a_id").join(at("b"), "b_id").where(close)
    return place_pairs(placed, pairs, block, linked.select(c("a_id").alias("x"), c("b_id").alias("y")))


def _near(g, radius, least=0.0, other_kind=False):
    """New pairs of entities from ``least`` to ``radius`` metres apart."""
    placed = g.entities.where("lat is not null").select("id", "lat", "lon", (c("entity_type") if other_kind else F.lit(None).cast("string")).alias("kind"))
    pairs = place_distances(placed, radius).where(c("metres") >= least).select("a_lat", "a_lon", "b_lat", "b_lon")
    return new_near(g, placed, pairs, haversine_m(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon")).between(least, radius))


_NEAR_NEW = "SELECT a_id AS x, b_id AS y FROM near WHERE "


@query("gen_proximity_500m", fresh(_NEAR_NEW + "metres <= 500 AND a_type <> b_type", f"WITH {NEAR_SQL}"))
def gen_proximity_500m(g):
    return _near(g, 500.0, other_kind=True)


@query("gen_proximity_deg", fresh("SELECT x, y FROM (SELECT a.id AS x, b.id AS y FROM entities a JOIN entities b ON a.id < b.id AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) < 0.1) t"))
def gen_proximity_deg(g, degrees=0.1):
    """Within a distance in degrees, by cells of that size; a little larger, so that rounding parts no near pair by two cells."""
    placed = g.entities.where("lat is not null").select("id", "lat", "lon", F.lit(None).cast("string").alias("kind"))
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    cell = lambda x: F.floor(c(x) / (degrees * (1 + 1e-9)))
    a = placed.select(c("lat").alias("a_lat"), c("lon").alias("a_lon")).distinct().withColumns({"cy": cell("a_lat"), "cx": cell("a_lon")})
    around = a.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step))
    b = around.select(c("a_lat").alias("b_lat"), c("a_lon").alias("b_lon"), (c("cy") + c("dy")).alias("cy"), (c("cx") + c("dx")).alias("cx"))
    close = F.sqrt(F.pow(c("a_lat") - c("b_lat"), 2) + F.pow(c("a_lon") - c("b_lon"), 2)) < degrees
    return new_near(g, placed, a.join(b, ["cy", "cx"]).where(close).select("a_lat", "a_lon", "b_lat", "b_lon"), close)


@query("gen_proximity_1km", fresh(_NEAR_NEW + "metres BETWEEN 10 AND 1000", f"WITH {NEAR_SQL}"))
def gen_proximity_1km(g):
    return _near(g, 1000.0, least=10.0)


@query("gen_anchor_nearby", fresh("SELECT a_id AS x, b_id AS y FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY floor(metres + 0.5), b_id) AS rn FROM near WHERE a_source = 'supplier' AND b_source <> 'supplier' AND metres BETWEEN 10 AND 1000) t WHERE rn <= 3", f"WITH {NEAR_SQL}"))
def gen_anchor_nearby(g, anchor="supplier", k=3):
    points = g.entities.select("id", "lat", "lon", "source")
    return new_pairs(k_nearest(points.where(c("source") == anchor), points.where(c("source") != anchor), 1000.0, k, least=10.0), g.edges, "a_id", "b_id")


@query("gen_proximity_3km", fresh("SELECT a_id AS x, b_id AS y FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY floor(metres + 0.5), b_id) AS rn FROM near WHERE a_type <> b_type AND metres BETWEEN 2000 AND 3000) t WHERE rn <= 2", f"WITH {NEAR_SQL}"))
def gen_proximity_3km(g, k=2):
    points = g.entities.select("id", "lat", "lon", "entity_type")
    found = k_nearest(points, points, 3000.0, k, least=2000.0, kind="entity_type").drop("rn")
    others = found.join(points.select(c("id").alias("a_id"), c("entity_type").alias("own")), "a_id").where("kind <> own")
    return new_pairs(first_per(others, ["a_id"], ["m", "b_id"]).where(c("rn") <= k), g.edges, "a_id", "b_id")


def _nearest_of(g, linked, radius, k):
    """New pairs of places without such edges with their k nearest, other type first."""
    points = g.entities.select("id", "lat", "lon", "entity_type")
    free = points.join(linked, c("id") == c("node"), "left_anti")
    return new_pairs(other_kind_first(k_nearest(free, points, radius, k, kind="entity_type"), free.select("id", "entity_type"), k), g.edges, "a_id", "b_id")


_NEAREST = "SELECT a_id AS x, b_id AS y FROM (SELECT n.*, row_number() OVER (PARTITION BY a_id ORDER BY CASE WHEN a_type <> b_type THEN 1 ELSE 0 END DESC, floor(metres + 0.5), b_id) AS rn FROM near n WHERE {} AND metres <= {}) t WHERE rn <= {}"


@query("gen_isolated_nearest", fresh(_NEAREST.format("NOT EXISTS (SELECT 1 FROM sym s WHERE s.node = a_id)", 1000, 3), f"WITH {NEAR_SQL}"))
def gen_isolated_nearest(g, k=3):
    return _nearest_of(g, nodes_of(g.edges), 1000.0, k)


@query("gen_unlinked_nearest", fresh(_NEAREST.format("NOT EXISTS (SELECT 1 FROM sym s WHERE s.node = a_id AND s.connection_type = 'pilgrimage_spot')", 2000, 5), f"WITH {NEAR_SQL}"))
def gen_unlinked_nearest(g, k=5):
    return _nearest_of(g, nodes_of(g.edges.where("connection_type = 'pilgrimage_spot'")), 2000.0, k)


_CELLS = "(SELECT id, source || '|' || CAST(floor(lat * 5) AS BIGINT) || '|' || CAST(floor(lon * 5) AS BIGINT) AS v FROM entities WHERE lat IS NOT NULL)"


@query("gen_region_cluster", fresh(f"SELECT a.id AS x, b.id AS y FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY id) AS rn FROM {_CELLS} s) a JOIN (SELECT *, row_number() OVER (PARTITION BY v ORDER BY id) AS rn FROM {_CELLS} s) b ON a.v = b.v AND a.rn < b.rn AND b.rn <= 8"))
def gen_region_cluster(g, cap=8):
    """Same source and cell: all pairs of the first eight."""
    cells = g.entities.where("lat is not null").select("id", F.concat_ws("|", "source", F.floor(c("lat") * 5).cast("string"), F.floor(c("lon") * 5).cast("string")).alias("v"))
    return new_pairs(capped_pairs(cells, ["v"], ["id"], cap), g.edges)


@query("gen_same_source_chain", fresh("SELECT a.id AS x, b.id AS y FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM entities) a JOIN (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM entities) b ON a.source = b.source AND b.rn BETWEEN a.rn + 1 AND a.rn + 4 AND b.rn <= 100 WHERE a.n BETWEEN 10 AND 5000"))
def gen_same_source_chain(g):
    """Sources of 10 to 5000 members: the first 100, each with its next four."""
    few = first_per(g.entities.select("id", "source"), ["source"], ["id"]).where("rn <= 100")
    fit = g.entities.groupBy("source").agg(F.count("*").alias("n")).where(c("n").between(10, 5000)).select("source")
    return new_pairs(linked_to_next(few.join(fit, "source", "left_semi").drop("rn"), ["source"], ["id"], 4), g.edges)


# ---- labels


_FIRST_WORD = "(SELECT id, lower(split_part(label, ' ', 1)) AS v FROM entities WHERE entity_type = '{}')"


@query("gen_label_cross_type", fresh(_cross_sql(_FIRST_WORD.format("artifact"), _FIRST_WORD.format("work"), "v", 20, 20)))
def gen_label_cross_type(g, cap=20):
    """Artifacts and works with one first word: the first ``cap`` of each."""
    e = g.entities.select("id", "entity_type", F.lower(F.split("label", " ")[0]).alias("v"))
    side = lambda kind: e.where(c("entity_type") == kind).select("id", "v")
    return new_pairs(capped_cross(side("artifact"), side("work"), "v", cap, cap), g.edges)


@query("gen_label_cross_type_grouped", fresh("SELECT a.id AS x, b.id AS y FROM (SELECT id, entity_type, substr(lower(label), 1, 2) AS k, row_number() OVER (PARTITION BY substr(lower(label), 1, 2) ORDER BY id) AS rn FROM entities) a JOIN (SELECT id, entity_type, substr(lower(label), 1, 2) AS k, row_number() OVER (PARTITION BY substr(lower(label), 1, 2) ORDER BY id) AS rn FROM entities) b ON a.k = b.k AND a.rn < b.rn AND b.rn <= 10 WHERE a.entity_type <> b.entity_type"))
def gen_label_cross_type_grouped(g, cap=10):
    e = g.entities.select("id", "entity_type", F.substring(F.lower("label"), 1, 2).alias("k"))
    few = first_per(e, ["k"], ["id"]).where(c("rn") <= cap)
    a, b = few.toDF("x", "xt", "k", "rx"), few.toDF("y", "yt", "k", "ry")
    return new_pairs(a.join(b, "k").where("rx < ry and xt <> yt"), g.edges)


_PREFIX = "(SELECT id, substr(label, 1, {}) AS v FROM iso)"


@query("gen_prefix_chain6", fresh(f"SELECT x, y FROM (SELECT id AS x, lead(id) OVER (PARTITION BY v ORDER BY id) AS y, count(*) OVER (PARTITION BY v) AS n FROM {_PREFIX.format(6)} p) t WHERE y IS NOT NULL AND n BETWEEN 2 AND 500", f"WITH {_ISOLATED}"))
def gen_prefix_chain6(g):
    return new_pairs(_prefix_chain(g, 6, 500), g.edges)


@query("gen_prefix_chain4", fresh(f"SELECT x, y FROM (SELECT id AS x, lead(id) OVER (PARTITION BY v ORDER BY id) AS y, row_number() OVER (PARTITION BY v ORDER BY id) AS rn FROM {_PREFIX.format(4)} p) t WHERE y IS NOT NULL AND rn < 200", f"WITH {_ISOLATED}"))
def gen_prefix_chain4(g):
    few = first_per(isolated(g).select("id", F.substring("label", 1, 4).alias("v")), ["v"], ["id"]).where("rn <= 200").drop("rn")
    return new_pairs(linked_to_next(few, ["v"], ["id"]), g.edges)


def _prefix_chain(g, n, most):
    members = isolated(g).select("id", F.substring("label", 1, n).alias("v"))
    fit = members.groupBy("v").agg(F.count("*").alias("n")).where(c("n").between(2, most)).select("v")
    return linked_to_next(members.join(fit, "v", "left_semi"), ["v"], ["id"])


# ---- relations and shared attributes


@query("gen_relation_pairs", fresh("SELECT e.id AS x, 3000000000000 + l.l_partkey AS y FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN entities e ON e.qid = 'Q' || CAST(o.o_custkey + 1 AS VARCHAR) WHERE l.l_linenumber = 1"))
def gen_relation_pairs(g):
    """Relations between outside ids, resolved to entities."""
    rel = g.table("orders").join(g.table("lineitem").where("l_linenumber = 1"), c("o_orderkey") == c("l_orderkey")).select(F.concat(F.lit("Q"), (c("o_custkey") + 1).cast("string")).alias("qid"), (3_000_000_000_000 + c("l_partkey")).cast("long").alias("y"))
    return new_pairs(rel.join(g.entities.where("qid is not null").select("qid", c("id").alias("x")), "qid"), g.edges)


def _kind(status):
    return F.when(status == "F", "influence").when(status == "O", "adaptation").otherwise("series")


@query("gen_property_typed", "SELECT DISTINCT 1000000000000 + o_custkey AS a_id, 2000000000000 + l_suppkey AS b_id, CASE o_orderstatus WHEN 'F' THEN 'influence' WHEN 'O' THEN 'adaptation' ELSE 'series' END AS connection_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = 1000000000000 + o_custkey AND k.b_id = 2000000000000 + l_suppkey)")
def gen_property_typed(g):
    """New edges of the type that a property of an item stands for."""
    both = g.table("orders").join(g.table("lineitem"), c("o_orderkey") == c("l_orderkey"))
    x, y = (1_000_000_000_000 + c("o_custkey")).cast("long"), (2_000_000_000_000 + c("l_suppkey")).cast("long")
    rows = both.select(F.least(x, y).alias("a_id"), F.greatest(x, y).alias("b_id"), _kind(c("o_orderstatus")).alias("connection_type")).where("a_id <> b_id").distinct()
    return rows.join(g.edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")


@query("gen_shared_attribute", fresh("SELECT a.id AS x, b.id AS y FROM (SELECT 3000000000000 + p_partkey AS id, p_brand AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) a JOIN (SELECT 3000000000000 + p_partkey AS id, p_brand AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) b ON a.v = b.v AND a.rn < b.rn AND b.rn <= 30"))
def gen_shared_attribute(g, cap=30):
    works = g.table("part").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("id"), c("p_brand").alias("v"))
    return new_pairs(capped_pairs(works, ["v"], ["id"], cap), g.edges)


@query("gen_creator_work", fresh("SELECT e.id AS x, 3000000000000 + l_partkey AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN entities e ON e.qid = 'Q' || CAST(o_custkey + 2 AS VARCHAR) WHERE e.entity_type = 'person'"))
def gen_creator_work(g):
    """Works whose creator, by an outside id, is a known person."""
    made = g.table("orders").join(g.table("lineitem"), c("o_orderkey") == c("l_orderkey")).select(F.concat(F.lit("Q"), (c("o_custkey") + 2).cast("string")).alias("qid"), (3_000_000_000_000 + c("l_partkey")).cast("long").alias("y")).distinct()
    people = g.entities.where("qid is not null and entity_type = 'person'").select("qid", c("id").alias("x"))
    return new_pairs(made.join(people, "qid"), g.edges)


@query("gen_food_region", fresh("SELECT 1000000000000 + c_custkey AS x, s AS y FROM customer JOIN (SELECT s_nationkey, min(2000000000000 + s_suppkey) AS s FROM supplier GROUP BY 1) t ON s_nationkey = c_nationkey"))
def gen_food_region(g):
    """Each with the first place of its own region."""
    first = g.table("supplier").groupBy("s_nationkey").agg(F.min(2_000_000_000_000 + c("s_suppkey")).alias("y"))
    return new_pairs(g.table("customer").join(first, c("c_nationkey") == c("s_nationkey")).select((1_000_000_000_000 + c("c_custkey")).alias("x"), "y"), g.edges)


@query("gen_ingredient", fresh("SELECT e.id AS x, 3000000000000 + p_partkey AS y FROM part JOIN entities e ON e.qid = 'Q' || CAST(p_partkey % 500 AS VARCHAR)"))
def gen_ingredient(g):
    wanted = g.table("part").select((3_000_000_000_000 + c("p_partkey")).alias("y"), F.concat(F.lit("Q"), (c("p_partkey") % 500).cast("string")).alias("qid"))
    return new_pairs(wanted.join(g.entities.where("qid is not null").select("qid", c("id").alias("x")), "qid"), g.edges)


_CHAIN = "SELECT x, y FROM (SELECT id AS x, lead(id) OVER (PARTITION BY axis, value_code ORDER BY h, id) AS y, row_number() OVER (PARTITION BY axis, value_code ORDER BY h, id) AS rn FROM (SELECT e.id, t.axis, t.value_code, md5('ch' || CAST(e.id AS VARCHAR)) AS h FROM {} e JOIN entity_tags t ON t.entity_id = e.id) u) w WHERE y IS NOT NULL AND rn < {}"


def _tag_chain(g, members, most):
    t = members.select("id").join(g.tags, c("id") == c("entity_id")).select("id", "axis", "value_code", hash_order("ch").alias("h"))
    few = first_per(t, ["axis", "value_code"], ["h", "id"]).where(c("rn") <= most).drop("rn")
    return new_pairs(linked_to_next(few, ["axis", "value_code"], ["h", "id"]), g.edges)


@query("gen_shared_tag_chain", fresh(_CHAIN.format("iso", 2000), f"WITH {_ISOLATED}"))
def gen_shared_tag_chain(g):
    """Isolated nodes of one tag in a seeded chain, 2000 at most."""
    return _tag_chain(g, isolated(g), 2000)


@query("gen_tag_chain_active", fresh(_CHAIN.format("(SELECT * FROM entities WHERE is_dormant = 0)", 500)))
def gen_tag_chain_active(g):
    return _tag_chain(g, g.entities.where("is_dormant = 0"), 500)


_FIRSTS = "f AS (SELECT t.value_code AS v, e.entity_type AS k, min(e.id) AS id FROM entity_tags t JOIN entities e ON e.id = t.entity_id WHERE t.axis = 'geography' GROUP BY 1, 2)"


@query("gen_type_geo_cross", fresh("SELECT a.id AS x, b.id AS y FROM f a JOIN f b ON a.v = b.v AND a.k < b.k", f"WITH {_FIRSTS}"))
def gen_type_geo_cross(g):
    """Per region and pair of types, the first of each."""
    f = tagged(g, "geography").join(g.entities.select("id", "entity_type"), "id").groupBy("v", "entity_type").agg(F.min("id").alias("id"))
    return new_pairs(f.toDF("v", "xk", "x").join(f.toDF("v", "yk", "y"), "v").where("xk < yk"), g.edges)


@query("gen_era_geo_cross", fresh("SELECT a.id AS x, b.id AS y FROM f a JOIN f b ON a.v = b.v AND a.era = b.era AND a.k < b.k", "WITH f AS (SELECT t.value_code AS era, substr(e.source, 1, 7) AS v, e.source AS k, min(e.id) AS id FROM entity_tags t JOIN entities e ON e.id = t.entity_id WHERE t.axis = 'era' GROUP BY 1, 2, 3)"))
def gen_era_geo_cross(g):
    """The same within an era."""
    f = tagged(g, "era").join(g.entities.select("id", "source"), "id").groupBy(c("v").alias("era"), F.substring("source", 1, 7).alias("v"), "source").agg(F.min("id").alias("id"))
    return new_pairs(f.toDF("era", "v", "xk", "x").join(f.toDF("era", "v", "yk", "y"), ["era", "v"]).where("xk < yk"), g.edges)


# ---- pilgrimage

_SPOTS = "spot AS (SELECT a_id AS place, b_id AS work FROM connections WHERE connection_type = 'pilgrimage_spot')"


def spots(g):
    return g.edges.where("connection_type = 'pilgrimage_spot'").select(c("a_id").alias("place"), c("b_id").alias("work"))


@query("gen_pilgrimage_nearby", fresh("SELECT a_id AS x, b_id AS y FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY floor(metres + 0.5), b_id) AS rn FROM near WHERE a_id IN (SELECT place FROM spot) AND metres <= 3000) t WHERE rn <= 10", f"WITH {_SPOTS}, {NEAR_SQL}"))
def gen_pilgrimage_nearby(g, k=10):
    points = g.entities.select("id", "lat", "lon")
    here = points.join(spots(g).select("place"), c("id") == c("place"), "left_semi")
    return new_pairs(k_nearest(here, points, 3000.0, k), g.edges, "a_id", "b_id")


@query("gen_pilgrimage_same_place", fresh("SELECT a.work AS x, b.work AS y FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY work) AS rn FROM spot) a JOIN (SELECT *, row_number() OVER (PARTITION BY place ORDER BY work) AS rn FROM spot) b ON a.place = b.place AND a.rn < b.rn AND b.rn <= 40", f"WITH {_SPOTS}"))
def gen_pilgrimage_same_place(g, cap=40):
    """Works that share a place, of each place's first forty."""
    return new_pairs(capped_pairs(spots(g).select("place", c("work").alias("id")), ["place"], ["id"], cap), g.edges)


@query("gen_pilgrimage_related", fresh("SELECT x, y FROM (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rn FROM (SELECT w.id, w.v, m.value_code AS w2 FROM (SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = 'medium') w JOIN entity_tags m ON m.entity_id = w.id AND m.axis = 'era' WHERE w.id IN (SELECT work FROM spot)) a JOIN (SELECT w.id, w.v, m.value_code AS w2 FROM (SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = 'medium') w JOIN entity_tags m ON m.entity_id = w.id AND m.axis = 'era') b ON a.v = b.v AND a.w2 = b.w2 AND a.id < b.id) t WHERE rn <= 3", f"WITH {_SPOTS}"))
def gen_pilgrimage_related(g, k=3):
    """A pilgrimage work with the next works that share both medium and era."""
    both = tagged(g, "medium").join(tagged(g, "era").withColumnRenamed("v", "w"), "id")
    linked = linked_to_next(both, ["v", "w"], ["id"], k).join(spots(g).select("work"), c("x") == c("work"), "left_semi")
    return new_pairs(linked, g.edges)


@query("gen_pilgrimage_regional", fresh(_cross_sql("(SELECT DISTINCT t.entity_id AS id, t.value_code AS v FROM entity_tags t WHERE axis = 'geography' AND t.entity_id IN (SELECT place FROM spot))", _GEO.format("person"), "v", 10, 10), f"WITH {_SPOTS}"))
def gen_pilgrimage_regional(g):
    here = tagged(g, "geography").join(spots(g).select("place"), c("id") == c("place"), "left_semi")
    return new_pairs(capped_cross(here, _geo(g, "person"), "v", 10, 10), g.edges)


@query("gen_pilgrimage_landmark", fresh("SELECT x, y FROM (SELECT s.work AS x, n.b_id AS y, row_number() OVER (PARTITION BY s.work ORDER BY min(floor(n.metres + 0.5)), n.b_id) AS rn FROM spot s JOIN near n ON n.a_id = s.place WHERE n.metres <= 3000 AND n.b_type = 'person' GROUP BY s.work, n.b_id) t WHERE rn <= 5", f"WITH {_SPOTS}, {NEAR_SQL}"))
def gen_pilgrimage_landmark(g, k=5):
    """Landmarks near any of a work's places, the nearest five."""
    points = g.entities.select("id", "lat", "lon", "entity_type")
    here = points.join(spots(g).select("place"), c("id") == c("place"), "left_semi")
    # who is not among the k nearest to a place is not among those of a work by that place
    near = k_nearest(here, points.where("entity_type = 'person'"), 3000.0, k).select(c("a_id").alias("place"), c("b_id").alias("y"), "m")
    best = spots(g).join(near, "place").groupBy(c("work").alias("x"), "y").agg(F.min("m").alias("m"))
    return new_pairs(first_per(best, ["x"], ["m", "y"]).where(c("rn") <= k), g.edges)


@query(
    "gen_work_spot",
    "WITH l AS (SELECT 3000000000000 + p_partkey AS work, p_partkey, CAST(2000000000000 + 1 + p_size * 37 % 120 AS BIGINT) AS spot FROM part), s AS (SELECT work, coalesce(e.id, 5000000000000 + p_partkey) AS id, e.id IS NULL AS created FROM l LEFT JOIN entities e ON e.id = l.spot AND e.entity_type = 'place') SELECT least(work, id) AS a_id, greatest(work, id) AS b_id, 'pilgrimage_spot' AS connection_type, created FROM s WHERE NOT EXISTS (SELECT 1 FROM connections k WHERE k.a_id = least(work, id) AND k.b_id = greatest(work, id))",
)
def gen_work_spot(g):
    """New edges of listed (work, spot) rows: with the known place, or with one that is created for it."""
    places = g.entities.where("entity_type = 'place'").select("id")
    listed = g.table("part").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("work"), (5_000_000_000_000 + c("p_partkey")).cast("long").alias("own"), (2_000_000_000_000 + 1 + c("p_size") * 37 % 120).cast("long").alias("spot"))
    spot = listed.join(places, c("id") == c("spot"), "left").select("work", F.coalesce("id", "own").alias("y"), c("id").isNull().alias("created"))
    rows = spot.select(F.least("work", "y").alias("a_id"), F.greatest("work", "y").alias("b_id"), F.lit("pilgrimage_spot").alias("connection_type"), "created")
    return rows.join(g.edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
