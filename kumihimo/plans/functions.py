"""Column expressions over the tables: each query shows one on every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance, geo, rules, strings, years
from ..model import ERAS, era_index, era_midpoint, era_of
from .aggregates import micro, micro_sql
from .registry import query

c = F.col
one = F.lit

_HERE = "CAST(35.0116 AS DOUBLE) AS la, CAST(135.7681 AS DOUBLE) AS lo"
_POINTS = f"WITH p AS (SELECT id, lat, lon, {_HERE} FROM entities WHERE lat IS NOT NULL) "


def _points(g):
    return g.entities.where("lat is not null").select("id", "lat", "lon", one(35.0116).alias("la"), one(135.7681).alias("lo"))


@query("fn_haversine", _POINTS + ", h AS (SELECT id, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) AS h FROM p) SELECT id, CAST(floor(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) + 0.5) AS BIGINT) AS metres FROM h")
def fn_haversine(g):
    return _points(g).select("id", F.floor(geo.haversine_m(c("la"), c("lo"), c("lat"), c("lon")) + 0.5).alias("metres"))


@query("fn_equirect_km", _POINTS + f"SELECT id, {micro_sql('sqrt(pow((lat - la) * 111.0, 2) + pow((lon - lo) * 111.0 * cos(radians(la)), 2))')} AS km6 FROM p")
def fn_equirect_km(g):
    return _points(g).select("id", micro(geo.equirect_km(c("la"), c("lo"), c("lat"), c("lon"))).alias("km6"))


@query("fn_manhattan_deg", _POINTS + f"SELECT id, {micro_sql('abs(lat - la) + abs(lon - lo)')} AS deg6 FROM p")
def fn_manhattan_deg(g):
    return _points(g).select("id", micro(geo.manhattan_deg(c("la"), c("lo"), c("lat"), c("lon"))).alias("deg6"))


@query("fn_euclid_deg", _POINTS + "SELECT id FROM p WHERE sqrt(pow(lat - la, 2) + pow(lon - lo, 2)) < 0.1")
def fn_euclid_deg(g):
    return _points(g).where(geo.euclid_deg(c("la"), c("lo"), c("lat"), c("lon")) < 0.1).select("id")


@query("fn_tile_xy", "SELECT id, CAST(floor((lon + 180.0) / 360.0 * 4096) AS BIGINT) AS x, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096) AS BIGINT) AS y FROM entities WHERE lat IS NOT NULL")
def fn_tile_xy(g, zoom=12):
    x, y = geo.tile_xy(c("lat"), c("lon"), zoom)
    return _points(g).select("id", x.alias("x"), y.alias("y"))


@query("fn_grid_cell", "SELECT CAST(floor(lat / 0.03) AS BIGINT) AS cy, CAST(floor(lon / 0.03) AS BIGINT) AS cx, count(*) AS n FROM entities WHERE lat IS NOT NULL GROUP BY 1, 2")
def fn_grid_cell(g, size=0.03):
    return _points(g).groupBy(F.floor(c("lat") / size).alias("cy"), F.floor(c("lon") / size).alias("cx")).agg(F.count("*").alias("n"))


@query("fn_density_cell", "SELECT id, CAST(least(4, greatest(0, floor((lat - 34.0) / 0.4))) AS BIGINT) AS row, CAST(least(4, greatest(0, floor((lon - 135.0) / 0.4))) AS BIGINT) AS col FROM entities WHERE lat IS NOT NULL")
def fn_density_cell(g):
    return _points(g).select("id", geo.density_cell(c("lat"), 34.0, 36.0, 5).alias("row"), geo.density_cell(c("lon"), 135.0, 137.0, 5).alias("col"))


@query("fn_parse_point", "SELECT id, CASE WHEN id % 7 <> 0 THEN lat END AS plat, CASE WHEN id % 7 <> 0 THEN lon END AS plon FROM entities WHERE lat IS NOT NULL")
def fn_parse_point(g):
    text = F.concat(one("Point("), F.when(c("id") % 7 == 0, c("lon") + 100).otherwise(c("lon")).cast("string"), one(" "), c("lat").cast("string"), one(")"))
    lat, lon = geo.parse_point(text)
    return _points(g).select("id", lat.alias("plat"), lon.alias("plon"))


# Region rectangles (the first hit counts) and the threshold ladder; they disagree by design.
RECTANGLES = [
    ("hokkaido", 41.3, 45.6, 139.3, 145.8),
    ("tohoku", 37.7, 41.5, 139.0, 141.7),
    ("kanto", 35.0, 37.0, 138.5, 140.9),
    ("chubu", 34.5, 37.8, 136.0, 139.0),
    ("kinki", 33.4, 35.8, 134.0, 136.8),
    ("chugoku", 33.7, 35.6, 130.8, 134.4),
    ("shikoku", 32.7, 34.3, 132.0, 134.8),
    ("kyushu", 30.0, 34.0, 129.5, 132.0),
    ("okinawa", 24.0, 27.0, 122.0, 131.0),
]
LADDER = [("hokkaido", "lat > 41.0"), ("tohoku", "lat > 38.0"), ("kanto", "lat > 36.0 AND lon > 138.5"), ("kinki", "lat > 35.0 AND lon < 137.0"), ("chubu", "lat > 34.0 AND lon > 137.0"), ("chugoku", "lat > 33.5 AND lon < 134.0"), ("shikoku", "lat > 33.0 AND lon > 133.0")]


def rectangle_sql() -> str:
    return "CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {x} AND {y} THEN '{n}'" for n, a, b, x, y in RECTANGLES) + " END"


@query("fn_coord_region_rect", f"SELECT id, {rectangle_sql()} AS region FROM entities WHERE lat IS NOT NULL")
def fn_coord_region_rect(g):
    return _points(g).select("id", F.expr(rectangle_sql()).alias("region"))


_LADDER_SQL = "CASE " + " ".join(f"WHEN {cond} THEN '{n}'" for n, cond in LADDER) + " ELSE 'kyushu' END"


@query("fn_coord_region_ladder", f"SELECT id, {_LADDER_SQL} AS region FROM entities WHERE lat IS NOT NULL")
def fn_coord_region_ladder(g):
    return _points(g).select("id", F.expr(_LADDER_SQL).alias("region"))


# ---- years


@query("fn_year_to_era9", f"SELECT id, {era_of()} AS era FROM entities WHERE release_year IS NOT NULL")
def fn_year_to_era9(g):
    return g.entities.where("release_year is not null").select("id", F.expr(era_of()).alias("era"))


@query(
    "fn_year_to_era11",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN y < {b} THEN '{e}'" for b, e in years.ERAS11) + f" ELSE '{years.LAST_ERA}' END AS era FROM (SELECT p_partkey, 600 + (p_partkey * 53) % 1500 AS y FROM part WHERE 600 + (p_partkey * 53) % 1500 >= 1000) t",
)
def fn_year_to_era11(g):
    y = 600 + (c("p_partkey") * 53) % 1500
    return g.table("part").where(y >= 1000).select("p_partkey", years.era11(F.concat(one("c. "), y.cast("string"), one("-01"))).alias("era"))


@query("fn_era_midpoint", f"SELECT entity_id, {era_midpoint('value_code')} AS middle FROM entity_tags WHERE axis = 'era'")
def fn_era_midpoint(g):
    return g.tags.where("axis = 'era'").select("entity_id", F.expr(era_midpoint("value_code")).alias("middle"))


@query("fn_active_year", "SELECT o_orderkey, CASE WHEN b <> 0 AND d <> 0 THEN CAST(floor((b + d) / 2.0) AS INT) WHEN b <> 0 THEN b + 30 WHEN d <> 0 THEN d - 30 END AS year FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1700 + o_custkey % 200 END AS INT) AS b, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1760 + o_custkey % 190 END AS INT) AS d FROM orders) t")
def fn_active_year(g):
    birth = F.when(c("o_orderkey") % 3 == 0, 0).otherwise(1700 + c("o_custkey") % 200).cast("int")
    death = F.when(c("o_orderkey") % 5 == 0, 0).otherwise(1760 + c("o_custkey") % 190).cast("int")
    return g.table("orders").select("o_orderkey", years.active_year(birth, death).alias("year"))


_REGNAL = [n for n, _ in years.REGNAL]


@query(
    "fn_regnal_year",
    "SELECT p_partkey, CASE WHEN y BETWEEN 1400 AND 2026 THEN y END AS year FROM (SELECT p_partkey, CAST(1 + p_partkey % 64 + CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(years.REGNAL)) + " END AS INT) AS y FROM part) t",
)
def fn_regnal_year(g):
    name = F.element_at(F.array(*map(one, _REGNAL)), (c("p_partkey") % 5 + 1).cast("int"))
    label = F.concat(c("p_name"), one(" "), name, (1 + c("p_partkey") % 64).cast("string"), one("年"))
    return g.table("part").select("p_partkey", years.regnal_year(label).alias("year"))


@query("fn_kanji_number", "SELECT p_partkey, CAST(p_partkey % 99 + 1 AS INT) AS n FROM part")
def fn_kanji_number(g):
    digits = F.array(*map(one, ["", *"一二三四五六七八九"]))
    n = (c("p_partkey") % 99 + 1).cast("int")
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    text = F.concat(F.when(tens > 1, F.element_at(digits, tens + 1)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.element_at(digits, ones + 1))
    return g.table("part").select("p_partkey", years.kanji_number(text).alias("n"))


def _dated(g, *parts):
    y = (1380 + c("p_partkey") % 700).cast("string")
    return g.table("part").select("p_partkey", F.concat(*[y if p is None else one(p) for p in parts]).alias("t"))


_YEAR_SQL = "SELECT p_partkey, CASE WHEN y BETWEEN 1400 AND 2026 THEN CAST(y AS INT) END AS year FROM (SELECT p_partkey, 1380 + p_partkey % 700 AS y FROM part) t"


@query("fn_year_semicolon", _YEAR_SQL)
def fn_year_semicolon(g):
    return _dated(g, "paper;", None, "-05-01").select("p_partkey", years.semicolon_year(c("t")).alias("year"))


@query("fn_year_disambig", _YEAR_SQL)
def fn_year_disambig(g):
    return _dated(g, "題（", None, "年の映画）").select("p_partkey", years.disambiguation_year(c("t")).alias("year"))


@query("fn_year_generic", _YEAR_SQL)
def fn_year_generic(g):
    return _dated(g, "the year ", None, "年").select("p_partkey", years.generic_year(c("t")).alias("year"))


# Period words in order of trial.
ERA_WORDS = [
    ("縄文|弥生|古墳|飛鳥|奈良時代|平安", "ancient"),
    ("鎌倉|室町|南北朝|戦国", "medieval"),
    ("安土桃山|慶長|元和|寛永|正保|慶安|承応|明暦|万治|寛文|延宝|天和|貞享|元禄", "edo_early"),
    ("宝永|正徳|享保|元文|寛保|延享|寛延|宝暦|明和|安永|天明|寛政|享和|文化|文政|天保|弘化|嘉永|安政|万延|文久|元治|慶応", "edo_late"),
    ("明治|大正", "meiji_taisho"),
    ("昭和[^戦]|昭和初|昭和[0-9]|昭和1[0-9]", "showa_prewar"),
    ("昭和[2-6][0-9]|昭和戦後|戦後", "showa_postwar"),
    ("平成", "heisei"),
    ("令和", "reiwa"),
]


def era_from_text(text):
    """Era by the first pattern that a text holds, else by its first three- or four-digit year. Years before the first era count to it, later ones to the last."""
    chain = None
    for pattern, era in ERA_WORDS:
        chain = F.when(text.rlike(pattern), era) if chain is None else chain.when(text.rlike(pattern), era)
    year = years.found_int(text, "([0-9]{3,4})年")
    for code, _, end in ERAS[:-1]:
        chain = chain.when(year < end, code)
    return chain.when(year.isNotNull(), ERAS[-1][0])


_ERA_SAMPLES = ["縄文時代", "室町中期", "元禄九年", "天保の頃", "大正ロマン", "昭和初期", "戦後すぐ", "平成元年", "令和五年", "1650年", "1890年", "no date"]
_ERA_RESULTS = ["ancient", "medieval", "edo_early", "edo_late", "meiji_taisho", "showa_prewar", "showa_postwar", "heisei", "reiwa", "edo_early", "meiji_taisho", None]


@query("fn_era_from_text", "SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERA_RESULTS) if e) + " END AS era FROM part")
def fn_era_from_text(g):
    text = F.concat(c("p_name"), one(" "), F.element_at(F.array(*map(one, _ERA_SAMPLES)), (c("p_partkey") % 12 + 1).cast("int")))
    return g.table("part").select("p_partkey", era_from_text(text).alias("era"))


@query("fn_month_key", "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, strftime(o_orderdate, '%m-%d') AS day FROM orders")
def fn_month_key(g):
    day = F.date_format("o_orderdate", "MM-dd")
    return g.table("orders").select("o_orderkey", F.split(day, "-")[0].cast("int").alias("month"), day.alias("day"))


# ---- strings


@query("fn_norm_title", "SELECT id, trim(label) AS t FROM entities")
def fn_norm_title(g):
    wide = F.translate(c("label"), strings._NARROW[:94], strings._WIDE[:94])
    return g.entities.select("id", strings.norm_title(wide).alias("t"))


@query("fn_strip_disambig", "SELECT p_partkey, p_name AS t FROM part")
def fn_strip_disambig(g):
    return g.table("part").select("p_partkey", strings.strip_disambiguation(F.concat(c("p_name"), one("（"), c("p_type"), one("）"))).alias("t"))


@query("fn_norm_label", "SELECT p_partkey, trim(p_name) AS t FROM part")
def fn_norm_label(g):
    return g.table("part").select("p_partkey", strings.norm_label(F.concat(one("【"), c("p_type"), one("】"), c("p_name"), one("("), c("p_brand"), one(")（x）"))).alias("t"))


@query("fn_clean_title", "SELECT doc_id, CASE WHEN length(t) BETWEEN 2 AND 300 THEN t END AS t FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) x")
def fn_clean_title(g):
    return g.table("documents").select("doc_id", strings.clean_title(c("text")).alias("t"))


@query("fn_qid", "SELECT id, qid AS q FROM entities WHERE qid IS NOT NULL")
def fn_qid(g):
    return g.entities.where("qid is not null").select("id", strings.qid(F.concat(one("http://example.org/entity/"), c("qid"))).alias("q"))


@query("fn_record_id", "SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9A-Za-z_]+[0-9]+)(?:\\?|$)', 1), ''), url) AS rid FROM pages")
def fn_record_id(g):
    return g.table("pages").select("page_id", strings.record_id(c("url")).alias("rid"))


@query("fn_prefix", "SELECT substr(label, 1, 6) AS p6, substr(label, 1, 4) AS p4, count(*) AS n FROM entities GROUP BY 1, 2")
def fn_prefix(g):
    return g.entities.groupBy(F.substring("label", 1, 6).alias("p6"), F.substring("label", 1, 4).alias("p4")).agg(F.count("*").alias("n"))


@query("fn_all_digits", "SELECT o_orderkey, regexp_matches(substr(CAST(o_totalprice AS VARCHAR), 1, 6), '^[0-9]+$') AS digits FROM orders")
def fn_all_digits(g):
    return g.table("orders").select("o_orderkey", strings.all_digits(F.substring(c("o_totalprice").cast("string"), 1, 6)).alias("digits"))


@query("fn_low_unique", "SELECT doc_id, len(list_distinct(string_split(substr(text, 1, 6), ''))) <= 4 AS low FROM documents")
def fn_low_unique(g):
    return g.table("documents").select("doc_id", strings.low_unique(F.substring("text", 1, 6), 4).alias("low"))


@query("fn_extract_quoted", "SELECT s_suppkey, s_name AS place FROM supplier")
def fn_extract_quoted(g):
    text = F.concat(one("作品は同じ場所「"), c("s_name"), one("」を舞台"))
    return g.table("supplier").select("s_suppkey", strings.quoted_place(text).alias("place"))


_PLACES = ["日本", "東京都", "大阪市", "鎌倉市", "東京ドーム", "江ノ島", "関東地方", ""]
_LEVELS = ["L1", "L3_prefecture", "L4_high_density", "L4_city", "L5_venue", "L5_spot", "L2", "UNKNOWN"]


@query("fn_granularity", "SELECT s_suppkey, CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LEVELS)) + " END AS level FROM supplier")
def fn_granularity(g):
    place = F.element_at(F.array(*map(one, _PLACES)), (c("s_suppkey") % 8 + 1).cast("int"))
    return g.table("supplier").select("s_suppkey", strings.granularity(place).alias("level"))


@query("fn_commons_url", "SELECT p_partkey, substr(md5(n), 1, 1) || '/' || substr(md5(n), 1, 2) || '/' || n AS path FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part) t")
def fn_commons_url(g):
    return g.table("part").select("p_partkey", strings.commons_path(c("p_name")).alias("path"))


@query("fn_capwords", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS t FROM part")
def fn_capwords(g):
    return g.table("part").select("p_partkey", F.initcap("p_name").alias("t"))


@query("fn_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS t FROM documents")
def fn_truncate(g):
    return g.table("documents").select("doc_id", strings.truncate(c("text")).alias("t"))


@query("fn_desc_label", "SELECT doc_id, CASE WHEN length(text) <= 80 AND NOT contains(text, ',') THEN text END AS t FROM documents")
def fn_desc_label(g):
    return g.table("documents").select("doc_id", strings.description_label(c("text")).alias("t"))


@query("fn_template", "SELECT a_id, b_id, CASE connection_type WHEN 'creator_work' THEN CAST(a_id AS VARCHAR) || ' made ' || CAST(b_id AS VARCHAR) WHEN 'pilgrimage_spot' THEN CAST(b_id AS VARCHAR) || ' is set at ' || CAST(a_id AS VARCHAR) ELSE CAST(a_id AS VARCHAR) || ' shares a source with ' || CAST(b_id AS VARCHAR) END AS said FROM connections")
def fn_template(g):
    """A sentence for each edge, by its rule."""
    a, b = c("a_id"), c("b_id")
    said = F.when(c("connection_type") == "creator_work", F.format_string("%d made %d", a, b)).when(c("connection_type") == "pilgrimage_spot", F.format_string("%d is set at %d", b, a)).otherwise(F.format_string("%d shares a source with %d", a, b))
    return g.edges.select("a_id", "b_id", said.alias("said"))


@query(
    "fn_text_overlap",
    """WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS r FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT conv_id, list_distinct(list_filter(string_split(q, ' '), lambda w: length(w) >= 3)) AS seg, r FROM u JOIN a USING (conv_id))
SELECT conv_id, CAST(least(5, greatest(1, floor(1 + 4.0 * len(list_filter(seg, lambda w: contains(r, w))) / greatest(len(seg), 1)))) AS INT) AS relevance,
CASE WHEN length(r) > 5000 THEN 5 WHEN length(r) > 2000 THEN 4 WHEN length(r) > 500 THEN 3 WHEN length(r) > 100 THEN 2 ELSE 1 END AS completeness FROM s""",
)
def fn_text_overlap(g):
    """Share of a question's words that its answer holds, and how long that is."""
    turns = g.table("conversations")
    said = lambda role, name: turns.where(c("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias(name))
    both = said("user", "q").join(said("assistant", "r"), "conv_id")
    seg = F.array_distinct(F.filter(F.split("q", " "), lambda w: F.length(w) >= 3))
    both = both.select("conv_id", "r", seg.alias("seg"))
    hit = F.size(F.filter("seg", lambda w: F.contains(c("r"), w)))
    n = F.length("r")
    return both.select(
        "conv_id",
        F.least(one(5), F.greatest(one(1), F.floor(1 + 4.0 * hit / F.greatest(F.size("seg"), one(1))))).cast("int").alias("relevance"),
        F.when(n > 5000, 5).when(n > 2000, 4).when(n > 500, 3).when(n > 100, 2).otherwise(1).alias("completeness"),
    )


# ---- sets and distances

_SETS_SQL = "WITH t AS (SELECT entity_id, list_sort(list(DISTINCT value_code)) AS v FROM entity_tags GROUP BY entity_id), e AS (SELECT k.a_id, k.b_id, coalesce(x.v, []) AS x, coalesce(y.v, []) AS y FROM connections k LEFT JOIN t x ON x.entity_id = k.a_id LEFT JOIN t y ON y.entity_id = k.b_id) "


def edge_sets(g, axis=None):
    """Edges with the sorted tag sets of both ends, x and y."""
    tags = g.tags if axis is None else g.tags.where(c("axis") == axis)
    sets = tags.groupBy("entity_id").agg(F.array_sort(F.collect_set("value_code")).alias("v"))
    none = F.array().cast("array<string>")
    out = g.edges.select("a_id", "b_id")
    for end, name in (("a_id", "x"), ("b_id", "y")):
        out = out.join(sets.select(c("entity_id").alias(end), c("v").alias(name)), end, "left").withColumn(name, F.coalesce(name, none))
    return out.select("a_id", "b_id", "x", "y")


@query("fn_jaccard", _SETS_SQL + f"SELECT a_id, b_id, {micro_sql('CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.5 ELSE 1 - len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END')} AS d6 FROM e")
def fn_jaccard(g):
    return edge_sets(g).select("a_id", "b_id", micro(distance.jaccard_distance(c("x"), c("y"))).alias("d6"))


@query(
    "fn_era_distance",
    f"""WITH i AS (SELECT id, {era_index('value_code')} AS k FROM entities JOIN entity_tags ON entity_id = id WHERE axis = 'era'),
p AS (SELECT id AS a_id, lead(id) OVER (PARTITION BY source ORDER BY id) AS b_id FROM entities WHERE entity_type IN ('work', 'place'))
SELECT p.a_id, p.b_id, {micro_sql('CASE WHEN x.k IS NULL OR y.k IS NULL THEN 0.5 ELSE abs(x.k - y.k) / 8.0 END')} AS d6 FROM p LEFT JOIN i x ON x.id = p.a_id LEFT JOIN i y ON y.id = p.b_id WHERE p.b_id IS NOT NULL""",
)
def fn_era_distance(g):
    from .windows import linked_to_next

    pairs = linked_to_next(g.entities.where("entity_type in ('work', 'place')").select("id", "source"), ["source"], ["id"]).select(c("x").alias("a_id"), c("y").alias("b_id"))
    sets = g.tags.where("axis = 'era'").groupBy("entity_id").agg(F.array_sort(F.collect_set("value_code")).alias("v"))
    none = F.array().cast("array<string>")
    both = pairs.join(sets.select(c("entity_id").alias("a_id"), c("v").alias("x")), "a_id", "left").join(sets.select(c("entity_id").alias("b_id"), c("v").alias("y")), "b_id", "left")
    return both.select("a_id", "b_id", micro(distance.era_distance(F.coalesce("x", none), F.coalesce("y", none))).alias("d6"))


def theme_parents(g):
    """A dictionary of themes: a part type's parent is its first two words, whose parent is its first."""
    t = g.tags.where("axis = 'theme'").select("value_code").distinct()
    words = F.split("value_code", " ")
    two, first = F.array_join(F.slice(words, 1, 2), " "), words[0]
    rows = F.array(F.struct(c("value_code").alias("code"), two.alias("parent")), F.struct(two.alias("code"), first.alias("parent")), F.struct(first.alias("code"), one(None).cast("string").alias("parent")))
    return t.select(F.explode(rows).alias("r")).select("r.code", "r.parent").where("parent is null or parent <> code").distinct()


_TREE_SQL = """th AS (SELECT DISTINCT value_code AS t FROM entity_tags WHERE axis = 'theme'),
pa0 AS (SELECT t AS code, array_to_string(string_split(t, ' ')[1:2], ' ') AS parent FROM th UNION SELECT array_to_string(string_split(t, ' ')[1:2], ' '), split_part(t, ' ', 1) FROM th UNION SELECT split_part(t, ' ', 1), NULL FROM th),
pa AS (SELECT * FROM pa0 WHERE parent IS NULL OR parent <> code),
up0 AS (SELECT DISTINCT code, code AS anc, 0 AS up FROM pa), up1 AS (SELECT u.code, p.parent AS anc, 1 AS up FROM up0 u JOIN pa p ON p.code = u.anc WHERE p.parent IS NOT NULL AND p.parent <> u.code),
up2 AS (SELECT u.code, p.parent AS anc, 2 AS up FROM up1 u JOIN pa p ON p.code = u.anc WHERE p.parent IS NOT NULL AND p.parent <> u.code),
up AS (SELECT code, anc, min(up) AS up FROM (SELECT * FROM up0 UNION ALL SELECT * FROM up1 UNION ALL SELECT * FROM up2) u GROUP BY 1, 2)"""


@query("fn_ancestors", f"WITH {_TREE_SQL} SELECT code, anc AS ancestor, up FROM up")
def fn_ancestors(g):
    return distance.closure(theme_parents(g))


@query(
    "fn_theme_distance",
    f"""WITH {_TREE_SQL}, st AS (SELECT x.code AS a, y.code AS b, min(x.up + y.up) AS s FROM up x JOIN up y ON x.anc = y.anc GROUP BY 1, 2),
w AS (SELECT entity_id AS id, value_code AS v FROM entity_tags WHERE axis = 'theme'), p AS (SELECT id AS a_id, lead(id) OVER (ORDER BY id) AS b_id FROM w)
SELECT p.a_id, p.b_id, {micro_sql('CASE WHEN st.s IS NULL THEN 0.8 ELSE least(0.6, st.s * 0.2) END')} AS d6 FROM p JOIN w x ON x.id = p.a_id JOIN w y ON y.id = p.b_id LEFT JOIN st ON st.a = x.v AND st.b = y.v""",
)
def fn_theme_distance(g):
    """Works of neighbouring ids, by the tree of their themes; the path table is broadcast (a dictionary)."""
    w = g.tags.where("axis = 'theme'").select(c("entity_id").alias("id"), c("value_code").alias("v"))
    steps = F.broadcast(distance.tree_distance(theme_parents(g)))
    b = w.select((c("id") - 1).alias("id"), c("id").alias("b_id"), c("v").alias("b"))
    pairs = w.select("id", c("v").alias("a")).join(b, "id")
    return pairs.join(steps, ["a", "b"], "left").select(c("id").alias("a_id"), "b_id", micro(distance.theme_distance(c("steps"), one(False))).alias("d6"))


@query(
    "fn_medium_distance",
    f"""WITH m AS (SELECT entity_id AS id, value_code AS v, substr(value_code, 1, 7) AS parent FROM entity_tags WHERE axis = 'medium' AND entity_id < 4000000000000),
p AS (SELECT x.id AS a_id, y.id AS b_id, CASE WHEN x.v = y.v THEN 0.0 WHEN x.v = y.parent OR y.v = x.parent THEN 0.15 WHEN x.parent = y.parent THEN 0.3 ELSE 1.0 END AS d FROM m x JOIN m y ON y.id = x.id + 1) SELECT a_id, b_id, {micro_sql('d')} AS d6 FROM p""",
)
def fn_medium_distance(g):
    """Brands of one maker are siblings."""
    m = g.tags.where("axis = 'medium' and entity_id < 4000000000000").select(c("entity_id").alias("id"), c("value_code").alias("a"), F.substring("value_code", 1, 7).alias("pa"))
    b = m.select((c("id") - 1).alias("id"), c("id").alias("b_id"), c("a").alias("b"), c("pa").alias("pb"))
    kin = F.when(c("a") == c("b"), 0).when((c("a") == c("pb")) | (c("b") == c("pa")), 1).when(c("pa") == c("pb"), 2)
    return m.join(b, "id").select(c("id").alias("a_id"), "b_id", micro(distance.medium_distance(kin, one(False))).alias("d6"))


_RULE_SQL = "(o_custkey % 11) / 10.0 AS td, (o_orderkey % 9) / 8.0 AS ed, (o_orderkey % 7) / 6.0 AS md, (o_custkey % 5) / 4.0 AS gd, (o_orderkey % 5) / 4.0 AS xd, CASE WHEN o_custkey % 2 = 0 THEN 'person' ELSE 'work' END AS ta, CASE WHEN o_orderkey % 3 = 0 THEN 'person' ELSE 'work' END AS tb"


def _rule_inputs(g):
    return g.table("orders").selectExpr("o_orderkey", *[x.strip() for x in _RULE_SQL.replace("/ 10.0", "/ 10D").replace("/ 8.0", "/ 8D").replace("/ 6.0", "/ 6D").replace("/ 4.0", "/ 4D").split(", ")])


@query(
    "fn_score_rule_v1",
    f"""WITH d AS (SELECT o_orderkey, {_RULE_SQL} FROM orders) SELECT o_orderkey, CASE WHEN td < 0.3 AND ed > 0.3 THEN 'era_bridge' WHEN td < 0.3 AND md > 0.5 THEN 'medium_cross' WHEN td < 0.3 AND gd > 0.5 THEN 'geo_theme'
WHEN td < 0.2 AND ed < 0.2 AND md < 0.2 THEN 'obvious' WHEN td > 0.7 AND ed > 0.7 AND md > 0.7 THEN 'random' ELSE 'default' END AS rule,
{micro_sql('CASE WHEN td < 0.3 AND ed > 0.3 THEN 1.2 * (1 - td) * ed WHEN td < 0.3 AND md > 0.5 THEN 1.1 * (1 - td) * md WHEN td < 0.3 AND gd > 0.5 THEN (1 - td) * gd WHEN td < 0.2 AND ed < 0.2 AND md < 0.2 THEN 0.2 WHEN td > 0.7 AND ed > 0.7 AND md > 0.7 THEN 0.05 ELSE 0.3 END')} AS score6 FROM d""",
)
def fn_score_rule_v1(g):
    r = rules.score_rule_v1(c("td"), c("ed"), c("md"), c("gd"))
    return _rule_inputs(g).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.rule", micro(c("r.score")).alias("score6"))


@query(
    "fn_score_rule_v2",
    f"""WITH d AS (SELECT o_orderkey, {_RULE_SQL} FROM orders), k AS (SELECT *, ta <> tb AS x, CASE WHEN ta <> tb THEN 1.1 ELSE 1.0 END AS m FROM d)
SELECT o_orderkey, CASE WHEN td < 0.5 AND ed > 0.3 THEN 'era_bridge' WHEN td < 0.5 AND md > 0.5 THEN 'medium_cross' WHEN td < 0.5 AND gd > 0.3 AND gd < 1.0 THEN 'geo_theme' WHEN td < 0.5 AND xd > 0.5 THEN 'experience_shift'
WHEN x AND td < 0.5 THEN 'cross_type_' || least(ta, tb) || '_' || greatest(ta, tb) WHEN td < 0.2 AND ed < 0.2 AND md < 0.2 THEN 'obvious' WHEN td > 0.7 AND ed > 0.7 AND md > 0.7 THEN 'random' ELSE 'default' END AS rule,
{micro_sql('CASE WHEN td < 0.5 AND ed > 0.3 THEN 1.2 * (1 - td) * ed * m WHEN td < 0.5 AND md > 0.5 THEN 1.1 * (1 - td) * md * m WHEN td < 0.5 AND gd > 0.3 AND gd < 1.0 THEN (1 - td) * gd * m WHEN td < 0.5 AND xd > 0.5 THEN 0.9 * (1 - td) * xd WHEN x AND td < 0.5 THEN 0.8 * (1 - td) WHEN td < 0.2 AND ed < 0.2 AND md < 0.2 THEN 0.15 WHEN td > 0.7 AND ed > 0.7 AND md > 0.7 THEN 0.05 WHEN td < 0.5 THEN 0.3 * (1 - td) ELSE 0.1 END')} AS score6 FROM k""",
)
def fn_score_rule_v2(g):
    r = rules.score_rule_v2(c("td"), c("ed"), c("md"), c("gd"), c("xd"), c("ta"), c("tb"))
    return _rule_inputs(g).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.rule", micro(c("r.score")).alias("score6"))


#: Keyword groups of themes, in order of trial.
KEYWORDS = {"metalwork": ["tin", "copper", "brass", "steel", "nickel"], "finish": ["polished", "brushed", "burnished", "anodized", "plated"], "size": ["small", "medium", "large", "economy", "promo", "standard"]}


@query("fn_keyword_multi", "SELECT p_partkey, theme FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS theme FROM part WHERE " + " OR ".join(f"contains(lower(p_type), '{w}')" for w in ws) for k, ws in KEYWORDS.items()) + ") t")
def fn_keyword_multi(g):
    """Every theme one of whose words a label holds."""
    hits = [F.when(F.lower("p_type").rlike("|".join(ws)), k) for k, ws in KEYWORDS.items()]
    return g.table("part").select("p_partkey", F.explode(F.array_compact(F.array(*hits))).alias("theme"))


@query("fn_keyword_first", "SELECT p_partkey, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_type), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in KEYWORDS.items()) + " ELSE 'none' END AS theme FROM part")
def fn_keyword_first(g):
    chain = None
    for k, ws in KEYWORDS.items():
        hit = F.lower("p_type").rlike("|".join(ws))
        chain = F.when(hit, k) if chain is None else chain.when(hit, k)
    return g.table("part").select("p_partkey", chain.otherwise("none").alias("theme"))


@query("fn_medium_detect", "SELECT id, CASE WHEN source LIKE 'src%' THEN 'text' WHEN label ILIKE '%steel%' THEN 'metal' WHEN entity_type = 'place' THEN 'site' WHEN entity_type = 'person' THEN 'life' ELSE 'object' END AS medium FROM entities")
def fn_medium_detect(g):
    """Source first, then the label's words, then the type."""
    kind = F.when(c("source").startswith("src"), "text").when(c("label").ilike("%steel%"), "metal").when(c("entity_type") == "place", "site").when(c("entity_type") == "person", "life").otherwise("object")
    return g.entities.select("id", kind.alias("medium"))


@query("fn_experience_detect", "SELECT id, CASE WHEN label ILIKE '%customer%' THEN 'meet' WHEN entity_type = 'place' THEN 'visit' WHEN entity_type = 'artifact' THEN 'read' ELSE 'see' END AS experience FROM entities")
def fn_experience_detect(g):
    kind = F.when(c("label").ilike("%customer%"), "meet").when(c("entity_type") == "place", "visit").when(c("entity_type") == "artifact", "read").otherwise("see")
    return g.entities.select("id", kind.alias("experience"))


@query("fn_class_code", "SELECT p_partkey, CASE substr(p_brand, 7, 1) WHEN '1' THEN 'general' WHEN '2' THEN 'thought' WHEN '3' THEN 'history' WHEN '4' THEN 'society' WHEN '5' THEN 'nature' END AS theme FROM part")
def fn_class_code(g):
    """A class digit's theme, from a map of literals."""
    themes = F.create_map(*[x for k, v in {"1": "general", "2": "thought", "3": "history", "4": "society", "5": "nature"}.items() for x in (one(k), one(v))])
    return g.table("part").select("p_partkey", F.try_element_at(themes, F.substring("p_brand", 7, 1)).alias("theme"))


@query("fn_genre_tag_map", f"SELECT p_partkey, p_type AS genre, {micro_sql('least(0.9, 0.5 + p_size * 2 / 200.0)')} AS confidence6 FROM part WHERE p_size * 2 >= 30")
def fn_genre_tag_map(g):
    """Tags of rank 30 or more, with a confidence that grows with the rank."""
    rank = c("p_size") * 2
    return g.table("part").where(rank >= 30).select("p_partkey", c("p_type").alias("genre"), micro(F.least(one(0.9), 0.5 + rank / 200.0)).alias("confidence6"))
