"""Integration, enrichment and curation jobs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from ..functions import strings, years
from ..functions.geo import haversine_m
from ..functions.rules import flagged
from ..model import era_of
from ..sources.graph import first_per
from ..vocabulary import DEFAULT_THEMES, DESIGNATIONS, KEYWORD_THEMES, PREFECTURE_POINTS, PROVINCE_POINTS
from .aggregates import micro, micro_sql
from .functions import rectangle_sql
from .generators import isolated
from .registry import query
from .windows import numbered

c = F.col


def dedupe_by_key(new, existing, key, order):
    """Rows of ``new`` whose key no row of ``existing`` has; of equal keys the first in order stays."""
    once = first_per(new.withColumn("key", key), ["key"], order).where("rn = 1")
    return once.join(existing.select(key.alias("key")).distinct(), "key", "left_anti").drop("rn")


@query(
    "job_dedupe_labels",
    "WITH d AS (SELECT doc_id, source, trim(lower(text)) AS key FROM documents) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS rn FROM d WHERE doc_id % 2 = 1) t WHERE rn = 1 AND key NOT IN (SELECT key FROM d WHERE doc_id % 2 = 0)",
)
def job_dedupe_labels(g):
    """New records (those of odd ids) whose whole folded label none of the others has; of equal ones the first source's."""
    docs = g.table("documents").select("doc_id", "source", c("text").alias("label"))
    key = F.trim(F.lower("label"))
    return dedupe_by_key(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), key, ["source", "doc_id"]).select("doc_id")


@query(
    "job_dedupe_qid_label",
    "SELECT o_orderkey FROM orders WHERE 'Q' || CAST(o_custkey + 700 AS VARCHAR) NOT IN (SELECT qid FROM entities WHERE qid IS NOT NULL) AND 'Supplier#' || lpad(CAST(o_orderkey % 300 AS VARCHAR), 9, '0') NOT IN (SELECT label FROM entities WHERE label IS NOT NULL)",
)
def job_dedupe_qid_label(g):
    """Unknown by id, then by label."""
    new = g.table("orders").select("o_orderkey", F.concat(F.lit("Q"), (c("o_custkey") + 700).cast("string")).alias("qid"), F.concat(F.lit("Supplier#"), F.lpad((c("o_orderkey") % 300).cast("string"), 9, "0")).alias("label"))
    return new.join(g.entities.where("qid is not null").select("qid"), "qid", "left_anti").join(g.entities.select("label"), "label", "left_anti").select("o_orderkey")


def unknown_places(new, known, metres=500.0, at_lat=46.0):
    """Rows of new (id, qid, label, lat, lon) that known (qid, label, lat, lon) lacks: none has its outside id, and none of its name lies nearer than that.

    Names meet within cells, and nothing is paired: a name that most rows have
    costs a look at its own cell.
    """
    high, wide = metres / 110_000.0, metres / (111_000.0 * math.cos(math.radians(at_lat)))
    cell = {"cy": F.floor(c("lat") / high), "cx": F.floor(c("lon") / wide)}
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    there = known.where("label is not null and lat is not null and lon is not null").select("label", "lat", "lon").distinct().withColumns(cell)
    around = there.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).select(c("label").alias("name"), c("lat").alias("y"), c("lon").alias("x"), (c("cy") + c("dy")).alias("ky"), (c("cx") + c("dx")).alias("kx"))
    fresh = new.join(known.where("qid is not null").select("qid"), "qid", "left_anti").withColumns(cell)
    same = (c("label") == c("name")) & (c("cy") == c("ky")) & (c("cx") == c("kx")) & (haversine_m(c("lat"), c("lon"), c("y"), c("x")) < metres)
    return fresh.join(around, same, "left_anti").drop("cy", "cx")


@query(
    "job_dedupe_name_radius",
    """WITH n AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Q' || (id % 900) END AS qid, CASE WHEN id % 7 = 0 THEN label || ' anew' ELSE label END AS label, lat + (id % 3) * 0.003 AS lat, lon FROM entities WHERE lat IS NOT NULL)
SELECT id FROM n WHERE (qid IS NULL OR qid NOT IN (SELECT qid FROM entities WHERE qid IS NOT NULL)) AND NOT EXISTS (SELECT 1 FROM (SELECT b.label, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM
 (SELECT e.label, pow(sin(radians(e.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - n.lon) / 2), 2) AS h FROM entities e WHERE e.label = n.label AND e.lat IS NOT NULL) b) k WHERE m < 500)""",
)
def job_dedupe_name_radius(g, metres=500.0):
    """Landed records with a place (the entities again: moved by 0, 333 or 667 m, some with another name, some with an outside id) that are new by id and by whole name and place."""
    qid = F.when(c("id") % 5 == 0, F.concat(F.lit("Q"), (c("id") % 900).cast("string")))
    name = F.when(c("id") % 7 == 0, F.concat("label", F.lit(" anew"))).otherwise(c("label"))
    new = g.entities.where("lat is not null").select("id", qid.alias("qid"), name.alias("label"), (c("lat") + (c("id") % 3) * 0.003).alias("lat"), "lon")
    return unknown_places(new, g.entities, metres).select("id")


def work_key(title, author):
    """Title and author folded, without white space, as one key."""
    fold = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", "")
    return F.concat_ws("|", fold(title), fold(author))


_FOLD_SQL = "concat_ws('|', regexp_replace(lower(coalesce({0}, '')), '\\s+', '', 'g'), regexp_replace(lower(coalesce({1}, '')), '\\s+', '', 'g'))"


@query(
    "job_dedupe_work_author",
    f"WITH cat AS (SELECT p_partkey AS id, {_FOLD_SQL.format('p_name', 'p_brand')} AS k FROM part), has AS (SELECT {_FOLD_SQL.format('label', 'source')} AS k FROM entities WHERE entity_type = 'artifact') SELECT min(id) AS id, k FROM cat WHERE k NOT IN (SELECT k FROM has) GROUP BY k",
)
def job_dedupe_work_author(g):
    """Catalogue rows whose title and author no record has yet, each pair once: the first by id."""
    cat = g.table("part").select(c("p_partkey").alias("id"), work_key(c("p_name"), c("p_brand")).alias("k"))
    has = g.entities.where("entity_type = 'artifact'").select(work_key(c("label"), c("source")).alias("k"))
    return cat.groupBy("k").agg(F.min("id").alias("id")).join(has, "k", "left_anti").select("id", "k")


def _theme_sql(label, kind):
    named = ", ".join("CASE WHEN " + " OR ".join(f"contains({label}, '{w}')" for w in words) + f" THEN '{theme}' END" for words, theme in KEYWORD_THEMES)
    default = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN '{t}'" for k, t in DEFAULT_THEMES.items()) + " END"
    found = f"list_filter(list_distinct([{named}]), lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE list_filter([{default}], lambda x: x IS NOT NULL) END"


def keyword_themes(label, kind):
    """Themes that a label's words name, each once; its type's default if none. Words are sought as they stand, without patterns, and what is found is bound once."""
    named = [F.when(reduce(lambda x, y: x | y, [F.contains(label, F.lit(w)) for w in words]), theme) for words, theme in KEYWORD_THEMES]
    found = F.array_distinct(F.array_compact(F.array(*named)))
    default = F.array_compact(F.array(*[F.when(kind == k, t) for k, t in DEFAULT_THEMES.items()]))
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(default)), 0)


@query(
    "job_autotag",
    f"WITH u AS (SELECT * FROM entities WHERE label IS NOT NULL) SELECT id, 'theme' AS axis, unnest({_theme_sql('label', 'entity_type')}) AS value_code FROM u UNION ALL SELECT id, 'medium', CASE WHEN entity_type = 'place' THEN 'site' WHEN entity_type = 'person' THEN 'life' ELSE 'object' END FROM u UNION ALL SELECT id, 'geography', "
    + rectangle_sql()
    + f" FROM u WHERE {rectangle_sql()} IS NOT NULL UNION ALL SELECT id, 'era', {era_of()} FROM u WHERE {era_of()} IS NOT NULL UNION ALL SELECT id, 'experience', CASE WHEN entity_type = 'place' THEN 'participatory' WHEN entity_type = 'person' THEN 'intellectual' END FROM u WHERE entity_type IN ('place', 'person')",
)
def job_autotag(g):
    """Tags on five axes from labels, types, years and places; themes from the words of the label."""
    kind, label = c("entity_type"), c("label")
    one = lambda axis, value: F.transform(F.array_compact(F.array(value)), lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("value_code")))
    themes = F.transform(keyword_themes(label, kind), lambda v: F.struct(F.lit("theme").alias("axis"), v.alias("value_code")))
    rows = F.concat(
        themes,
        one("medium", F.when(kind == "place", "site").when(kind == "person", "life").otherwise("object")),
        one("geography", F.expr(rectangle_sql())),
        one("era", F.expr(era_of())),
        one("experience", F.when(kind == "place", "participatory").when(kind == "person", "intellectual")),
    )
    return g.entities.where("label is not null").select("id", F.explode(rows).alias("t")).select("id", "t.axis", "t.value_code")


@query("job_source_default_tags", "SELECT e.id, d.axis, d.value_code FROM entities e JOIN (VALUES ('supplier', 'geography', 'ASIA'), ('src0', 'medium', 'en'), ('BUILDING', 'experience', 'BUILDING')) d(source, axis, value_code) ON d.source = e.source WHERE NOT EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND t.axis = d.axis AND t.value_code = d.value_code)")
def job_source_default_tags(g, defaults=(("supplier", "geography", "ASIA"), ("src0", "medium", "en"), ("BUILDING", "experience", "BUILDING"))):
    """Each source's default tags, for its entities that lack them."""
    dim = g.spark.createDataFrame(list(defaults), "source string, axis string, value_code string")
    want = g.entities.select("id", "source").join(F.broadcast(dim), "source").select("id", "axis", "value_code")
    return want.join(g.tags.select(c("entity_id").alias("id"), "axis", "value_code"), ["id", "axis", "value_code"], "left_anti")


#: What an occupation says: medium, themes, experience. The tables' segments stand for occupations.
OCCUPATIONS = [
    ("AUTOMOBILE", "industrial_design", ("mecha", "craft_mastery"), "participatory"),
    ("BUILDING", "architecture", ("craft_mastery",), "immersive"),
    ("FURNITURE", "craft", ("craft_mastery", "everyday_beauty"), None),
    ("MACHINERY", None, ("mecha",), "intellectual"),
]
#: Words of place labels with their themes and experience, in order of trial.
PLACE_WORDS = [("#00000000", ("sacred_profane", "community_tradition"), "contemplative"), ("#0000000", ("war_conflict",), "immersive"), ("#", ("nature_communion",), None)]
#: Themes of genres and media of formats. Part types stand for genres, brands for formats.
GENRE_THEMES = [("ECONOMY", "everyday_beauty"), ("LARGE", "battle"), ("MEDIUM", "identity_self"), ("PROMO", "music_performance"), ("SMALL", "humor_satire")]
FORMAT_MEDIA = [("Brand#1", "anime_tv"), ("Brand#2", "anime_movie"), ("Brand#3", "anime_ova"), ("Brand#4", "manga"), ("Brand#5", "light_novel")]


def tag(axis, value, confidence):
    """A tag of one row, or none where the value is null."""
    return F.when(value.isNotNull(), F.struct(F.lit(axis).alias("axis"), value.alias("value_code"), F.lit(confidence).alias("confidence")))


def as_tags(rows, ones, lists=()):
    """(id, ...) -> id, axis, value_code, confidence from single tags and from (axis, array of values, confidence)."""
    many = [F.transform(F.coalesce(v, F.array().cast("array<string>")), _tagged(axis, confidence)) for axis, v, confidence in lists]
    return rows.select("id", F.explode(F.concat(F.array_compact(F.array(*ones)), *many)).alias("t")).select("id", "t.axis", "t.value_code", "t.confidence")


def _tagged(axis, confidence):
    return lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("value_code"), F.lit(confidence).alias("confidence"))


_ACTIVE_SQL = "CASE WHEN birth IS NOT NULL AND death IS NOT NULL THEN CAST(floor((birth + death) / 2.0) AS INT) WHEN birth IS NOT NULL THEN birth + 30 WHEN death IS NOT NULL THEN death - 30 END"
_OCC_SQL = ", ".join(f"('{o}', {chr(39) + m + chr(39) if m else 'NULL'}, {list(t)}, {chr(39) + e + chr(39) if e else 'NULL'})" for o, m, t, e in OCCUPATIONS)


@query(
    "job_tag_persons",
    f"""WITH o(occ, medium, themes, experience) AS (VALUES {_OCC_SQL}), p AS (SELECT CAST(1000000000000 + c_custkey AS BIGINT) AS id, c_mktsegment AS occ, CASE WHEN c_custkey % 3 <> 0 THEN 1500 + c_custkey % 480 END AS birth, CASE WHEN c_custkey % 4 <> 0 THEN 1560 + c_custkey % 480 END AS death FROM customer),
y AS (SELECT id, {_ACTIVE_SQL} AS year FROM p), e AS (SELECT id, {era_of('year')} AS era FROM y)
SELECT id, 'medium' AS axis, medium AS value_code, CAST(0.9 AS DOUBLE) AS confidence FROM p JOIN o USING (occ) WHERE medium IS NOT NULL UNION ALL SELECT id, 'theme', unnest(themes), 0.7 FROM p JOIN o USING (occ)
UNION ALL SELECT id, 'experience', experience, 0.7 FROM p JOIN o USING (occ) WHERE experience IS NOT NULL UNION ALL SELECT id, 'era', era, 0.8 FROM e WHERE era IS NOT NULL""",
)
def job_tag_persons(g, occupations=OCCUPATIONS):
    """Medium, themes and experience from a person's occupation, by a table of them; the era from the years of birth and death."""
    dim = g.spark.createDataFrame(list(occupations), "occ string, medium string, themes array<string>, experience string")
    key = c("c_custkey")
    birth, death = F.when(key % 3 != 0, 1500 + key % 480), F.when(key % 4 != 0, 1560 + key % 480)
    people = g.table("customer").select((1_000_000_000_000 + key).cast("long").alias("id"), c("c_mktsegment").alias("occ"), years.active_year(birth, death).alias("year")).join(F.broadcast(dim), "occ", "left")
    return as_tags(people, [tag("medium", c("medium"), 0.9), tag("experience", c("experience"), 0.7), tag("era", F.expr(era_of("year")), 0.8)], [("theme", c("themes"), 0.7)])


_WORD_SQL = lambda pick: "CASE " + " ".join(f"WHEN contains(label, '{w}') THEN {pick(t, e)}" for w, t, e in PLACE_WORDS) + " END"


@query(
    "job_tag_places",
    f"""WITH p AS (SELECT *, {_WORD_SQL(lambda t, e: list(t))} AS themes, {_WORD_SQL(lambda t, e: repr(e) if e else 'NULL')} AS experience, {rectangle_sql()} AS region FROM entities WHERE entity_type = 'place')
SELECT id, 'geography' AS axis, region AS value_code, CAST(0.95 AS DOUBLE) AS confidence FROM p WHERE region IS NOT NULL UNION ALL SELECT id, 'theme', unnest(themes), 0.7 FROM p UNION ALL SELECT id, 'experience', experience, 0.6 FROM p WHERE experience IS NOT NULL UNION ALL SELECT id, 'medium', 'architecture', 0.5 FROM p""",
)
def job_tag_places(g, words=PLACE_WORDS):
    """Geography from coordinates; themes and experience by the first of the words that the label holds; every place is architecture."""
    themes = experience = None
    for w, t, e in words:
        hit, t, e = F.contains("label", F.lit(w)), F.array(*map(F.lit, t)), F.lit(e).cast("string")
        themes = F.when(hit, t) if themes is None else themes.when(hit, t)
        experience = F.when(hit, e) if experience is None else experience.when(hit, e)
    places = g.entities.where("entity_type = 'place'")
    return as_tags(places, [tag("geography", F.expr(rectangle_sql()), 0.95), tag("experience", experience, 0.6), tag("medium", F.lit("architecture"), 0.5)], [("theme", themes, 0.7)])


_PAIRS_SQL = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)


@query(
    "job_tag_works",
    f"""WITH gt(p_type, theme) AS (VALUES {_PAIRS_SQL(GENRE_THEMES)}), fm(p_brand, medium) AS (VALUES {_PAIRS_SQL(FORMAT_MEDIA)}), w AS (SELECT id, {era_of()} AS era FROM entities WHERE entity_type = 'work')
SELECT CAST(3000000000000 + p_partkey AS BIGINT) AS id, 'theme' AS axis, theme AS value_code, CAST(0.9 AS DOUBLE) AS confidence FROM part JOIN gt USING (p_type) UNION ALL SELECT 3000000000000 + p_partkey, 'medium', medium, 0.9 FROM part JOIN fm USING (p_brand) UNION ALL SELECT id, 'era', era, 0.95 FROM w WHERE era IS NOT NULL""",
)
def job_tag_works(g, genres=GENRE_THEMES, formats=FORMAT_MEDIA):
    """Themes from a catalogue's genres, media from its formats, the era from the year of release."""
    catalogue = g.table("part").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("id"), c("p_type").alias("genre"), c("p_brand").alias("form"))
    theme, medium = g.spark.createDataFrame(list(genres), "genre string, theme string"), g.spark.createDataFrame(list(formats), "form string, medium string")
    works = g.entities.where("entity_type = 'work'").select("id", "release_year").join(catalogue, "id").join(F.broadcast(theme), "genre", "left").join(F.broadcast(medium), "form", "left")
    return as_tags(works, [tag("theme", c("theme"), 0.9), tag("medium", c("medium"), 0.9), tag("era", F.expr(era_of()), 0.95)])


#: The theme that says least, and words of labels that name a better one.
GENERIC = "craft_mastery"
SPECIFIC_WORDS = [("ring", "love_bond"), ("bolt", "mecha"), ("red", "seasonal_beauty"), ("steel", "war_conflict"), ("gear", "mecha")]

_THEMED_SQL = f"t0 AS (SELECT CAST(3000000000000 + p_partkey AS BIGINT) AS id, '{GENERIC}' AS theme FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT 3000000000000 + p_partkey, p_type FROM part WHERE p_size % 5 = 0)"


@query(
    "job_retag_specific",
    f"""WITH {_THEMED_SQL}, only_ AS (SELECT id FROM t0 GROUP BY id HAVING count(*) FILTER (WHERE theme <> '{GENERIC}') = 0 AND count(*) > 0),
n AS (SELECT DISTINCT o.id, k.theme FROM only_ o JOIN entities e USING (id) JOIN (VALUES {_PAIRS_SQL(SPECIFIC_WORDS)}) k(word, theme) ON contains(e.label, k.word))
SELECT id, theme FROM t0 WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, theme FROM n""",
)
def job_retag_specific(g):
    """Works whose only theme is the generic one take the themes that their label's words name; where it names none, and for all others, tags stay."""
    part = g.table("part").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("id"), "p_size", "p_type")
    themes = part.where("p_size % 3 <> 0").select("id", F.lit(GENERIC).alias("theme")).unionByName(part.where("p_size % 5 = 0").select("id", c("p_type").alias("theme")))
    return specific_themes(themes, g.entities.select("id", "label"))


def specific_themes(themes, labels, generic=GENERIC, words=SPECIFIC_WORDS):
    """themes: (id, theme), labels: (id, label). What is affected is found first; the rest of the tags passes by unread."""
    vague = themes.groupBy("id").agg(F.count_if(c("theme") != generic).alias("others")).where("others = 0").select("id")
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("label", F.lit(w)), t) for w, t in words])))
    better = labels.join(vague, "id").select("id", named.alias("named")).where(F.size("named") > 0)
    return themes.join(better.select("id"), "id", "left_anti").unionByName(better.select("id", F.explode("named").alias("theme")))


@query("job_retag_catalog", "SELECT entity_id, axis, value_code FROM entity_tags WHERE NOT (axis = 'medium' AND entity_id - 3000000000000 IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)) UNION ALL SELECT 3000000000000 + p_partkey, 'medium', 'catalogue' FROM part WHERE p_partkey % 3 = 0")
def job_retag_catalog(g):
    """Weak tags of matched works go, the catalogue's come."""
    matched = g.table("part").where("p_partkey % 3 = 0").select((3_000_000_000_000 + c("p_partkey")).cast("long").alias("entity_id"), F.lit("medium").alias("axis"))
    kept = g.tags.join(matched, ["entity_id", "axis"], "left_anti").select("entity_id", "axis", "value_code")
    return kept.unionByName(matched.withColumn("value_code", F.lit("catalogue")))


@query(
    "job_release_year_tiers",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1868 + p_partkey % 40 WHEN p_partkey % 4 = 1 THEN 1950 + p_partkey % 50 WHEN p_partkey % 4 = 2 THEN 1900 + p_partkey % 90 END AS year, CASE WHEN p_partkey % 4 = 0 THEN 'regnal' WHEN p_partkey % 4 = 1 THEN 'semicolon' WHEN p_partkey % 4 = 2 THEN 'generic' END AS tier FROM part",
)
def job_release_year_tiers(g):
    """Tiers in order; each fills only what the ones before left empty."""
    p = c("p_partkey")
    text = lambda base, n: (base + p % n).cast("string")
    label = F.when(p % 4 == 0, F.concat(F.lit("明治"), text(1, 40), F.lit("年"))).when(p % 4 == 1, F.concat(F.lit("x;"), text(1950, 50), F.lit("-01-02"))).when(p % 4 == 2, F.concat(F.lit("the "), text(1900, 90), F.lit("年"))).otherwise(c("p_name"))
    t = g.table("part").select("p_partkey", label.alias("label"))
    tiers = [("regnal", years.regnal_year(c("label"))), ("semicolon", years.semicolon_year(c("label"))), ("disambiguation", years.disambiguation_year(c("label"))), ("generic", years.generic_year(c("label")))]
    first = F.coalesce(*[F.when(y.isNotNull(), F.struct(y.alias("year"), F.lit(n).alias("tier"))) for n, y in tiers])
    return t.select("p_partkey", first.alias("f")).select("p_partkey", "f.year", "f.tier")


@query("job_release_year_catalog", "SELECT e.id, coalesce(e.release_year, m.y) AS year, e.release_year IS NULL AND m.y IS NOT NULL AS filled FROM entities e LEFT JOIN (SELECT lower(s_name) AS k, min(1900 + s_suppkey % 120) AS y FROM supplier GROUP BY 1) m ON m.k = lower(e.label)")
def job_release_year_catalog(g):
    """A catalogue's year for matched titles, only where there is none."""
    cat = g.table("supplier").groupBy(F.lower("s_name").alias("k")).agg(F.min(1900 + c("s_suppkey") % 120).alias("y"))
    out = g.entities.select("id", "release_year", F.lower("label").alias("k")).join(cat, "k", "left")
    return out.select("id", F.coalesce("release_year", "y").alias("year"), (c("release_year").isNull() & c("y").isNotNull()).alias("filled"))


@query("job_fill_from_lookup", "SELECT e.id, coalesce(e.label_en, c.c_name) AS label_en, e.lat FROM entities e LEFT JOIN customer c ON e.qid = 'Q' || CAST(c.c_custkey AS VARCHAR)")
def job_fill_from_lookup(g):
    """English labels from a lookup by outside id, only where there is none."""
    look = g.table("customer").select(F.concat(F.lit("Q"), c("c_custkey").cast("string")).alias("qid"), "c_name")
    return g.entities.select("id", "qid", "label_en", "lat").join(look, "qid", "left").select("id", F.coalesce("label_en", "c_name").alias("label_en"), "lat")


_RANK_SQL = "CASE d " + " ".join(f"WHEN '{q}' THEN {i}" for i, (q, _) in enumerate(DESIGNATIONS)) + " END"
_NAME_SQL = "CASE prio " + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(DESIGNATIONS)) + " END"


@query(
    "job_heritage_rank",
    f"WITH k AS (SELECT l_partkey AS item, [{', '.join(repr(q) for q, _ in DESIGNATIONS)}, 'Q0'][l_linenumber] AS d, year(l_shipdate) AS y, l_orderkey AS o FROM lineitem), r AS (SELECT item, {_RANK_SQL} AS prio, y, o FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY prio, o) AS rn FROM r WHERE prio IS NOT NULL) SELECT item, {_NAME_SQL} AS heritage, CAST(CASE WHEN y BETWEEN 600 AND 2026 THEN y END AS INT) AS year FROM b WHERE rn = 1",
)
def job_heritage_rank(g):
    """The highest designation of each and its year, from landed (item, designation, date) rows; ids outside the table of designations say nothing.

    Of equal designations the least order counts, and a row without an order
    only where no other has that designation. Rows that are equal in both are
    a tie that the rule leaves open; here the least year is taken.
    """
    # numbers outside the list have no designation; those below nought count from its end
    n, size = c("l_linenumber"), len(DESIGNATIONS) + 1
    at = F.when(n.between(1, size), n - 1).when(n.between(-size, -1), n + size).cast("int")
    ids = F.array(*[F.lit(q) for q, _ in DESIGNATIONS], F.lit("Q0"))
    rows = g.table("lineitem").select(c("l_partkey").alias("item"), F.get(ids, at).alias("d"), F.year("l_shipdate").alias("y"), c("l_orderkey").alias("o"))
    table_ = g.spark.createDataFrame([(q, i, name) for i, (q, name) in enumerate(DESIGNATIONS)], "d string, prio int, heritage string")
    year = F.when(c("y").between(600, 2026), c("y")).alias("year")
    ranked = rows.join(F.broadcast(table_), "d").select("item", F.struct("prio", c("o").isNull().alias("none"), "o", "heritage", year).alias("r"))
    return ranked.groupBy("item").agg(F.min("r").alias("r")).select("item", "r.heritage", "r.year")


#: Millionths of a degree between the points of a layout.
SPACING = 10_000


def laid_out(g, members, group):
    """members: (id, group, lat6, lon6 of the group's centre) -> id, group, lat6, lon6: points of a square grid around each centre, a hundredth of a degree apart, by id. Coordinates are in millionths of a degree."""
    at = numbered(g, members, [group], ["id"]).withColumn("side", F.ceil(F.sqrt("n")).cast("long"))
    row, column = c("i") % c("side"), F.floor(c("i") / c("side"))
    away = lambda k: ((2 * k - c("side")) * (SPACING // 2)).cast("long")
    return at.select("id", group, (c("lat6") + away(row)).alias("lat6"), (c("lon6") + away(column)).alias("lon6"))


_LAID_SQL = "lat6 + (2 * (i % side) - side) * 5000 AS lat6, lon6 + (2 * CAST(floor(i / CAST(side AS DOUBLE)) AS BIGINT) - side) * 5000 AS lon6"
_NUMBERED_SQL = "row_number() OVER (PARTITION BY {0} ORDER BY id) - 1 AS i, CAST(ceil(sqrt(count(*) OVER (PARTITION BY {0}))) AS BIGINT) AS side"


@query(
    "job_geo_from_tag",
    f"""WITH t AS (SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = 'geography'),
p AS (SELECT v, CAST(floor(sum(CAST(floor(lat * 1e6 + 0.5) AS BIGINT)) / count(*)) AS BIGINT) AS lat6, CAST(floor(sum(CAST(floor(lon * 1e6 + 0.5) AS BIGINT)) / count(*)) AS BIGINT) AS lon6 FROM entities JOIN t USING (id) WHERE lat IS NOT NULL GROUP BY v),
m AS (SELECT id, v, lat6, lon6, {_NUMBERED_SQL.format('v')} FROM entities JOIN t USING (id) JOIN p USING (v) WHERE lat IS NULL AND is_dormant = 0) SELECT id, v, {_LAID_SQL} FROM m""",
)
def job_geo_from_tag(g):
    """Coordinates for tagged entities without a place: around the middle of those of the same tag that have one."""
    t = g.tags.where("axis = 'geography'").select(c("entity_id").alias("id"), c("value_code").alias("v"))
    tagged = g.entities.select("id", "lat", "lon", "is_dormant").join(t, "id")
    middle = lambda x: F.floor(F.sum(F.floor(c(x) * 1e6 + 0.5)) / F.count("*")).cast("long")
    centres = tagged.where("lat is not null").groupBy("v").agg(middle("lat").alias("lat6"), middle("lon").alias("lon6"))
    return laid_out(g, tagged.where("lat is null and is_dormant = 0").select("id", "v").join(centres, "v"), "v")


_PLACES_IN_LABELS = [*sorted(PREFECTURE_POINTS, key=lambda p: -len(p[0])), *sorted(PROVINCE_POINTS, key=lambda p: -len(p[0]))]


def _place_sql(text):
    return "CASE " + " ".join(f"WHEN contains({text}, '{name}') THEN {i}" for i, (name, _, _) in enumerate(_PLACES_IN_LABELS)) + " END"


@query(
    "job_geo_from_label",
    f"WITH t AS (SELECT id, label || ' ' || (['', '大阪府', '和歌山の寺', '土佐日記', 'x'])[CAST(id % 5 AS INT) + 1] AS label FROM entities WHERE lat IS NULL AND label IS NOT NULL AND is_dormant = 0), k AS (SELECT id, {_place_sql('label')} AS i FROM t), q AS (SELECT id, ([{', '.join(repr(p[0]) for p in _PLACES_IN_LABELS)}])[i + 1] AS place, {micro_sql(f'([{chr(44).join(str(p[1]) for p in _PLACES_IN_LABELS)}])[i + 1]')} AS lat6, {micro_sql(f'([{chr(44).join(str(p[2]) for p in _PLACES_IN_LABELS)}])[i + 1]')} AS lon6 FROM k WHERE i IS NOT NULL) SELECT id, place, {_LAID_SQL} FROM (SELECT *, {_NUMBERED_SQL.format('place')} FROM q) x",
)
def job_geo_from_label(g):
    """Coordinates for each entity without any whose label names a prefecture, else an old province; longer names first, each entity once, those of one place around it."""
    more = F.element_at(F.array(*map(F.lit, ["", "大阪府", "和歌山の寺", "土佐日記", "x"])), (c("id") % 5 + 1).cast("int"))
    t = g.entities.where("lat is null and label is not null and is_dormant = 0").select("id", F.concat_ws(" ", "label", more).alias("label"))
    return laid_out(g, located(t), "place")


def located(labels):
    """(id, label) -> id, place, lat6, lon6."""
    point = lambda p: F.struct(F.lit(p[0]).alias("place"), F.lit(float(p[1])).alias("lat"), F.lit(float(p[2])).alias("lon"))
    first = F.coalesce(*[F.when(F.contains("label", F.lit(p[0])), point(p)) for p in _PLACES_IN_LABELS])
    return labels.select("id", first.alias("p")).where("p is not null").select("id", "p.place", micro(c("p.lat")).alias("lat6"), micro(c("p.lon")).alias("lon6"))


@query(
    "job_verdict_merge",
    f"WITH v AS (SELECT 2000000000000 + l_suppkey AS a_id, 3000000000000 + l_partkey AS b_id, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'keep' END AS verdict, CAST(l_discount AS DOUBLE) AS theme_score, CAST(l_tax AS DOUBLE) AS era_score, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) SELECT k.a_id, k.b_id, {micro_sql('coalesce(theme_score, -1)')} AS theme6, {micro_sql('coalesce(era_score, -1)')} AS era6 FROM connections k LEFT JOIN v ON v.a_id = k.a_id AND v.b_id = k.b_id AND rn = 1 WHERE coalesce(v.verdict, k.verdict) = 'keep'",
)
def job_verdict_merge(g):
    """Edges with the latest of their landed verdicts and its scores; what is not kept goes. An edge without one keeps its own verdict."""
    log = g.table("lineitem").select(
        (2_000_000_000_000 + c("l_suppkey")).cast("long").alias("a_id"),
        (3_000_000_000_000 + c("l_partkey")).cast("long").alias("b_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.when(c("l_returnflag") == "R", "reject").otherwise("keep").alias("verdict"), c("l_discount").cast("double").alias("theme"), c("l_tax").cast("double").alias("era")).alias("v"),
    )
    latest = log.groupBy("a_id", "b_id").agg(F.max("v").alias("v"))
    joined = g.edges.select("a_id", "b_id", "verdict").join(latest, ["a_id", "b_id"], "left").where(F.coalesce("v.verdict", "verdict") == "keep")
    score = lambda name: micro(F.coalesce(c(f"v.{name}"), F.lit(-1.0)))
    return joined.select("a_id", "b_id", score("theme").alias("theme6"), score("era").alias("era6"))


_AUDITED_SQL = "s AS (SELECT k.a_id, k.b_id, substr(e.label, 1, 6) || e.source AS p FROM connections k JOIN entities e ON e.id = k.b_id)"


@query(
    "job_audit_prefix",
    f"WITH {_AUDITED_SQL}, b AS (SELECT p FROM s GROUP BY p HAVING regexp_matches(p, '^[0-9０-９]+$') OR len(list_distinct(string_split(p, ''))) <= 2 OR (count(*) > 400 AND p NOT IN ('red wiBrand#3', 'blue bBrand#4'))) SELECT a_id, b_id FROM s WHERE p NOT IN (SELECT p FROM b)",
)
def job_audit_prefix(g, most=400, exempt=("red wiBrand#3", "blue bBrand#4")):
    """Edges of groups that are numeric, monotonous or of more than 400 edges go, but not for their number those of an exempt list. A group is the first six characters of a work's label (that is the rule's feature) and its source."""
    labels = g.entities.select(c("id").alias("b_id"), F.concat(F.substring("label", 1, 6), "source").alias("p"))
    return audited(g.edges.select("a_id", "b_id").join(labels, "b_id"), most, exempt).select("a_id", "b_id")


def audited(edges, most, exempt):
    """Edges with a group p -> those of groups that no rule takes out; numbers are of all edges of a group."""
    large = (c("n") > most) & ~c("p").isin(*exempt)
    bad = edges.groupBy("p").agg(F.count("*").alias("n")).where(strings.all_digits(c("p")) | strings.low_unique(c("p")) | large).select("p")
    return edges.join(bad, "p", "left_anti")


_SAME_PLACE_SQL = """sp AS (SELECT a_id AS place, b_id AS work, row_number() OVER (PARTITION BY a_id ORDER BY b_id) AS rn FROM connections WHERE connection_type = 'pilgrimage_spot'),
pl AS (SELECT CAST(2000000000000 + s_suppkey AS BIGINT) AS place, CASE WHEN s_acctbal > 7000 THEN r_name WHEN s_acctbal > 5000 THEN n_name || ' hall' WHEN s_acctbal > 2000 THEN n_name || '市' ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e0 AS (SELECT a.work AS a_id, b.work AS b_id, pl.name FROM sp a JOIN sp b ON a.place = b.place AND a.rn < b.rn AND b.rn <= 12 JOIN pl ON pl.place = a.place),
lv AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, CASE WHEN name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN 'L2' WHEN name IN ('CHINA市', 'FRANCE市', 'BRAZIL市') THEN 'L4_high_density' WHEN contains(name, 'hall') THEN 'L5_venue' WHEN regexp_matches(name, '(市|町|村|区)$') THEN 'L4_city' ELSE 'L5_spot' END AS level FROM e0)"""


@query(
    "job_filter_granularity",
    f"WITH {_SAME_PLACE_SQL} SELECT lv.a_id, lv.b_id, name, level FROM lv JOIN entities x ON x.id = lv.a_id JOIN entities y ON y.id = lv.b_id WHERE level = 'L5_spot' OR (level = 'L4_city' AND n <= 5000 AND NOT (x.source = y.source AND x.source IN ('Brand#1', 'Brand#2', 'Brand#3')))",
)
def job_filter_granularity(g, most=5000, generic=("Brand#1", "Brand#2", "Brand#3")):
    """Edges of works that share a place, by how fine the place is: a spot's stay; a city's stay where it has at most ``most`` of them and the ends are not of one generic kind; those of regions, large cities and venues go."""
    from .generators import spots
    from .windows import capped_pairs

    bal = c("s_acctbal")
    name = F.when(bal > 7000, c("r_name")).when(bal > 5000, F.concat("n_name", F.lit(" hall"))).when(bal > 2000, F.concat("n_name", F.lit("市"))).otherwise(c("s_name"))
    places = g.table("supplier").join(g.table("nation"), c("s_nationkey") == c("n_nationkey")).join(g.table("region"), c("n_regionkey") == c("r_regionkey"))
    names = places.select((2_000_000_000_000 + c("s_suppkey")).cast("long").alias("place"), name.alias("name"))
    pairs = capped_pairs(spots(g).select("place", c("work").alias("id")), ["place"], ["id"], 12).join(names, "place").select(c("x").alias("a_id"), c("y").alias("b_id"), "name")
    level = strings.granularity(c("name"), regions=["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], dense=["CHINA市", "FRANCE市", "BRAZIL市"], venues=["hall"])
    return fine_places(pairs.withColumn("level", level), g.entities.select("id", c("source").alias("kind")), most, generic).select("a_id", "b_id", "name", "level")


def fine_places(edges, kinds, most, generic):
    """edges: (a_id, b_id, name, level), kinds: (id, kind). A place's number is that of all its edges, not of those seen so far."""
    often = edges.where("level = 'L4_city'").groupBy("name").agg(F.count("*").alias("n")).where(c("n") > most).select("name")
    kept = edges.where("level = 'L5_spot'").unionByName(edges.where("level = 'L4_city'").join(often, "name", "left_anti").select(edges.columns))
    end = lambda e, k: kinds.select(c("id").alias(e), c("kind").alias(k))
    both = kept.join(end("a_id", "ak"), "a_id").join(end("b_id", "bk"), "b_id")
    alike = (c("level") == "L4_city") & (c("ak") == c("bk")) & c("ak").isin(*generic)
    return both.where(~F.coalesce(alike, F.lit(False)))


@query("job_filter_blocklist", "SELECT id FROM entities WHERE label NOT IN ('red widget', 'small ring') AND NOT regexp_matches(label, '^(Supplier|Customer)#0+[1-3]$')")
def job_filter_blocklist(g, exact=("red widget", "small ring"), pattern="^(Supplier|Customer)#0+[1-3]$"):
    """Entities that neither the lists nor an added rule takes out."""
    kept = g.entities.where(~c("label").isin(*exact) & ~c("label").rlike(pattern))
    return flagged(kept).where(F.size("flags") == 0).select("id")


@query("job_dormant", "SELECT id, CASE WHEN qid IS NULL AND lat IS NULL AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.node = e.id) AND NOT EXISTS (SELECT 1 FROM entity_tags t WHERE t.entity_id = e.id AND t.confidence >= 0.7) THEN 1 ELSE 0 END AS dormant FROM entities e")
def job_dormant(g):
    """1 for what has no edge, no outside id, no place and no firm tag."""
    tagged = g.tags.where("confidence >= 0.7").select(c("entity_id").alias("id"))
    out = isolated(g).where("qid is null and lat is null").join(tagged, "id", "left_anti").select("id", F.lit(1).alias("d"))
    return g.entities.select("id").join(out, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("dormant"))
