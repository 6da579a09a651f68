"""Joins: endpoints, counts, grids, bands, fallback chains, fuzzy labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..model import ERAS
from ..sources.graph import both_ways, first_per, nodes_of
from .registry import query

c = F.col


@query("join_edges_entities", "SELECT k.a_id, k.b_id, x.label AS a_label, y.label AS b_label FROM connections k JOIN entities x ON k.a_id = x.id JOIN entities y ON k.b_id = y.id")
def join_edges_entities(g):
    name = lambda end: g.entities.select(c("id").alias(f"{end}_id"), c("label").alias(f"{end}_label"))
    return g.edges.select("a_id", "b_id").join(name("a"), "a_id").join(name("b"), "b_id").select("a_id", "b_id", "a_label", "b_label")


@query("join_edge_either_end", "SELECT e.id, count(*) AS n FROM entities e JOIN connections k ON k.a_id = e.id OR k.b_id = e.id WHERE e.entity_type = 'place' GROUP BY e.id")
def join_edge_either_end(g):
    places = g.entities.where("entity_type = 'place'").select("id")
    return g.both_ways.select("node").join(places, c("node") == c("id")).groupBy("id").agg(F.count("*").alias("n"))


@query(
    "join_left_count",
    "SELECT e.id, count(s.other) AS n FROM entities e LEFT JOIN sym s ON s.node = e.id AND s.verdict = 'keep' GROUP BY e.id",
)
def join_left_count(g):
    """Kept edges of each entity, 0 included: counted first, then joined."""
    n = both_ways(g.kept).groupBy("node").agg(F.count("*").alias("n"))
    return g.entities.select("id").join(n, c("id") == c("node"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "join_left_dim_counts",
    "SELECT n_name AS name, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
)
def join_left_dim_counts(g):
    return g.table("nation").join(g.table("supplier"), c("n_nationkey") == c("s_nationkey"), "left").groupBy(c("n_name").alias("name")).agg(F.count_distinct("s_suppkey").alias("n"))


@query("join_semi", "SELECT id FROM entities e WHERE EXISTS (SELECT 1 FROM sym s WHERE s.node = e.id AND s.connection_type LIKE 'pilgrimage%')")
def join_semi(g):
    return g.entities.join(nodes_of(g.edges.where(c("connection_type").startswith("pilgrimage"))), c("id") == c("node"), "left_semi").select("id")


@query("join_anti", "SELECT id, lat, lon FROM entities e WHERE lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.node = e.id)")
def join_anti(g):
    return g.entities.where("lat is not null").join(nodes_of(g.edges), c("id") == c("node"), "left_anti").select("id", "lat", "lon")


@query("join_self_inequality", "SELECT a.id AS a_id, b.id AS b_id FROM entities a JOIN entities b ON lower(a.label) = b.label_en AND a.entity_type = b.entity_type AND a.id < b.id + 1")
def join_self_inequality(g):
    a = g.entities.select(c("id").alias("a_id"), F.lower("label").alias("k"), "entity_type")
    b = g.entities.select(c("id").alias("b_id"), c("label_en").alias("k"), "entity_type")
    return a.join(b, ["k", "entity_type"]).where("a_id < b_id + 1").select("a_id", "b_id")


def grid_pairs(left, right, radius_m: float, at_lat: float = 46.0):
    """Pairs (a.*, b.*) within radius_m, as an equi-join on grid cells.

    A cell is as high as the radius and as wide as it is at latitude
    ``at_lat``, where a degree of longitude is shortest, so near pairs lie in
    neighbouring cells at most. Frames have id, lat, lon and columns of their
    own; the left's are named a_*, the right's b_*.
    """
    high, wide = radius_m / 110_000.0, radius_m / (111_000.0 * math.cos(math.radians(at_lat)))
    cell = lambda df: df.where("lat is not null and lon is not null").withColumns({"cy": F.floor(c("lat") / high), "cx": F.floor(c("lon") / wide)})
    named = lambda df, p: df.select(*[c(x).alias(x if x in ("cy", "cx") else f"{p}_{x}") for x in df.columns])
    a = named(cell(left), "a")
    b = named(cell(right), "b")
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    b = b.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).withColumns({"cy": c("cy") + c("dy"), "cx": c("cx") + c("dx")}).drop("dy", "dx")
    away = haversine_m(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"))
    return a.join(b, ["cy", "cx"]).withColumn("metres", away).where(c("metres") <= radius_m).drop("cy", "cx")


def place_distances(placed, radius_m: float):
    """(a_lat, a_lon, b_lat, b_lon, metres) of the places within radius_m of each other, in both orders."""
    places = placed.select("lat", "lon").distinct()
    return grid_pairs(places, places, radius_m)


#: Members of a place in one block, and pairs that one task makes.
BLOCK, TASK_PAIRS = 2000, 30_000_000


def place_pairs(placed, near, block=BLOCK, linked=None):
    """Pairs of entities at places that are near: a_id < b_id and the columns of the places' pair.

    placed (id, lat, lon, kind); near (a_lat, a_lon, b_lat, b_lon and columns
    that are the same from either place), in both orders. Kinds differ, unless
    they are null or empty. linked (x, y) are pairs of ids that are left out.

    Places are compared instead of entities. The members of a place and kind
    stand in blocks, each pair of places and of their blocks is met once, and
    pairs of members are made by the last step alone: rows of two blocks are
    shuffled, not pairs, to as many tasks as hold a bounded number of pairs.
    """
    place, key = ["lat", "lon"], ["lat", "lon", "kind", "part"]
    rest = [x for x in near.columns if x not in ("a_lat", "a_lon", "b_lat", "b_lon")]
    placed = placed.select("id", *place, F.coalesce("kind", F.lit("")).alias("kind"))
    once = near.where(F.struct("a_lat", "a_lon") <= F.struct("b_lat", "b_lon"))
    parts = placed.groupBy(*place, "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = placed.join(parts, [*place, "kind"]).select("id", *place, "kind", F.pmod(F.xxhash64("id"), c("parts")).cast("int").alias("part"))
    blocks = dealt.groupBy(*key).agg(F.collect_list("id").alias("ids"))
    end = lambda e: blocks.select(*[c(x).alias(f"{e}_{x}") for x in place], F.struct(*key).alias(e), c("ids").alias(f"{e}_ids"))
    met = once.join(end("a"), ["a_lat", "a_lon"]).join(end("b"), ["b_lat", "b_lon"]).where("a <= b and (a.kind <> b.kind or a.kind = '')")
    partners = c("b_ids")
    if linked is not None:
        spot = lambda e: dealt.select(c("id").alias(e), F.struct(*key).alias(f"{e}_at"))
        ends = linked.join(spot("x"), "x").join(spot("y"), "y").select(F.array_sort(F.array(F.struct(c("x_at").alias("at"), c("x").alias("id")), F.struct(c("y_at").alias("at"), c("y").alias("id")))).alias("e"))
        known = ends.groupBy(c("e")[0]["at"].alias("a"), c("e")[1]["at"].alias("b")).agg(F.collect_list(F.struct(c("e")[0]["id"].alias("x"), c("e")[1]["id"].alias("y"))).alias("known"))
        met = met.join(known, ["a", "b"], "left")
        own = F.transform(F.filter("known", lambda k: k["x"] == c("x")), lambda k: k["y"])
        partners = F.when(c("known").isNull(), c("b_ids")).otherwise(F.array_except("b_ids", own))
    shown = ["b_ids", *rest] if linked is None else ["b_ids", "known", *rest]
    rows = met.select((c("a") == c("b")).alias("same"), "a_ids", *shown).repartition(pair_tasks(placed, once))
    pairs = rows.select("same", F.explode("a_ids").alias("x"), *shown).select("same", "x", F.explode(partners).alias("y"), *rest).where("x < y or (not same and x > y)")
    return pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), *rest)


def pair_tasks(placed, once):
    """Tasks for the pairs of members of near places: counted from the places."""
    n = placed.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    end = lambda e: n.select(c("lat").alias(f"{e}_lat"), c("lon").alias(f"{e}_lon"), c("n").cast("double").alias(f"{e}_n"))
    pairs = once.join(end("a"), ["a_lat", "a_lon"]).join(end("b"), ["b_lat", "b_lon"]).agg(F.sum(c("a_n") * c("b_n"))).first()[0]
    return max(1, min(placed.sparkSession.sparkContext.defaultParallelism, math.ceil((pairs or 0) / 100_000)), math.ceil((pairs or 0) / TASK_PAIRS))


_HAVERSINE_SQL = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"
NEAR_SQL = """near AS (
  SELECT *, {away} AS metres FROM (
    SELECT a.id AS a_id, b.id AS b_id, a.entity_type AS a_type, b.entity_type AS b_type, a.source AS a_source, b.source AS b_source,
           pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
    FROM entities a JOIN entities b ON b.lat BETWEEN a.lat - 0.03 AND a.lat + 0.03 AND b.lon BETWEEN a.lon - 0.045 AND a.lon + 0.045 AND a.id <> b.id
  ) t)""".format(away=_HAVERSINE_SQL)


@query("join_grid_radius", f"WITH {NEAR_SQL} SELECT a_id, b_id, CAST(floor(metres + 0.5) AS BIGINT) AS metres FROM near WHERE metres <= 1000 AND a_type <> b_type AND a_id < b_id")
def join_grid_radius(g, radius=1000.0):
    """Entities of two types within a distance, by pairs of their places."""
    placed = g.entities.where("lat is not null").select("id", "lat", "lon", c("entity_type").alias("kind"))
    return place_pairs(placed, place_distances(placed, radius).withColumn("metres", F.floor(c("metres") + 0.5)))


_ERAS_SQL = ", ".join(f"('{e}', {a}, {b})" for e, a, b in ERAS)


@query("join_range_band", f"SELECT id, era FROM entities JOIN (VALUES {_ERAS_SQL}) v(era, lo, hi) ON release_year >= lo AND release_year < hi")
def join_range_band(g):
    """Year in band; the band table has nine rows, so it is broadcast."""
    eras = g.spark.createDataFrame(ERAS, "era string, lo int, hi int")
    return g.entities.where("release_year is not null").join(F.broadcast(eras), (c("release_year") >= c("lo")) & (c("release_year") < c("hi"))).select("id", "era")


#: Rectangles, of which the first that holds a point names it.
RECTANGLES = [("inner", 34.6, 35.2, 135.4, 136.0), ("north", 35.0, 36.0, 135.0, 137.0), ("east", 34.0, 36.0, 136.0, 137.0)]


@query("join_rect_first", "SELECT id, CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {x} AND {y} THEN '{n}'" for n, a, b, x, y in RECTANGLES) + " ELSE 'other' END AS rect FROM entities WHERE lat IS NOT NULL")
def join_rect_first(g):
    named = None
    for name, a, b, x, y in RECTANGLES:
        inside = c("lat").between(a, b) & c("lon").between(x, y)
        named = F.when(inside, name) if named is None else named.when(inside, name)
    return g.entities.where("lat is not null").select("id", named.otherwise("other").alias("rect"))


@query(
    "join_fallback_chain",
    """WITH cat AS (SELECT p_partkey AS cid, CASE WHEN p_size > 25 THEN 3000000000000 + p_partkey END AS eid_hint, CASE WHEN p_size % 2 = 0 THEN p_name END AS native, upper(p_name) AS english FROM part),
w AS (SELECT * FROM entities WHERE entity_type = 'work'),
m AS (SELECT cid, id, 1 AS pr FROM cat JOIN w ON w.id = cat.eid_hint UNION ALL SELECT cid, id, 2 FROM cat JOIN w ON w.label = cat.native
      UNION ALL SELECT cid, id, 3 FROM cat JOIN w ON lower(w.label_en) = lower(cat.english))
SELECT cid, id, pr FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY pr, id) AS rn FROM m) t WHERE rn = 1""",
)
def join_fallback_chain(g):
    """Catalogue rows matched by id, else by native title, else by English title; the first way that finds one counts. A title's least id stands for all works that bear it, as no other is chosen."""
    hint, native = F.when(c("p_size") > 25, 3_000_000_000_000 + c("p_partkey")), F.when(c("p_size") % 2 == 0, c("p_name"))
    cat = g.table("part").select(c("p_partkey").alias("cid"), hint.alias("hint"), native.alias("native"), F.upper("p_name").alias("english"))
    w = g.entities.where("entity_type = 'work'").select("id", "label", F.lower("label_en").alias("folded"))
    first = lambda title: w.groupBy(title).agg(F.min("id").alias("id"))
    way = lambda found, n: found.select("cid", "id", F.lit(n).alias("pr"))
    found = (
        way(cat.join(w, c("hint") == c("id")), 1)
        .unionByName(way(cat.join(first("label"), c("native") == c("label")), 2))
        .unionByName(way(cat.join(first("folded"), F.lower("english") == c("folded")), 3))
    )
    return found.groupBy("cid").agg(F.min(F.struct("pr", "id")).alias("m")).select("cid", "m.id", "m.pr")


@query(
    "join_label_key_chain",
    """WITH a AS (SELECT id, label FROM entities WHERE entity_type = 'artifact'),
k AS (SELECT id, label AS key, 1 AS pr FROM a UNION ALL SELECT id, trim(lower(label)), 2 FROM a UNION ALL SELECT id, regexp_replace(trim(lower(label)), '[.,]', '', 'g'), 3 FROM a),
t AS (SELECT DISTINCT trim(lower(text)) AS key, source FROM documents)
SELECT id, source, pr FROM (SELECT k.id, t.source, k.pr, row_number() OVER (PARTITION BY k.id ORDER BY k.pr, t.source) AS rn FROM k JOIN t USING (key)) x WHERE rn = 1""",
)
def join_label_key_chain(g):
    """Exact label, then folded, then without marks."""
    a = g.entities.where("entity_type = 'artifact'").select("id", "label")
    folded = F.trim(F.lower("label"))
    keys = a.select("id", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(n).alias("pr")) for n, k in ((1, c("label")), (2, folded), (3, F.regexp_replace(folded, "[.,]", "")))])).alias("k")).select("id", "k.key", "k.pr")
    t = g.table("documents").select(F.trim(F.lower("text")).alias("key"), "source").distinct()
    return keys.join(t, "key").groupBy("id").agg(F.min(F.struct("pr", "source")).alias("m")).select("id", "m.source", "m.pr")


@query(
    "join_qid_pairs",
    "SELECT DISTINCT x.id AS a_id, y.id AS b_id FROM orders o JOIN entities x ON x.qid = 'Q' || o.o_custkey JOIN entities y ON y.qid = 'Q' || (o.o_custkey + o.o_orderkey % 5) WHERE x.id <> y.id",
)
def join_qid_pairs(g):
    """(qid, qid) relations resolved to ids; unresolved and self pairs go."""
    rel = g.table("orders").select(F.concat(F.lit("Q"), c("o_custkey").cast("string")).alias("qa"), F.concat(F.lit("Q"), (c("o_custkey") + c("o_orderkey") % 5).cast("string")).alias("qb")).distinct()
    known = g.entities.where("qid is not null").select("qid", "id")
    out = rel.join(known.select(c("qid").alias("qa"), c("id").alias("a_id")), "qa").join(known.select(c("qid").alias("qb"), c("id").alias("b_id")), "qb")
    return out.where("a_id <> b_id").select("a_id", "b_id").distinct()


@query("join_broadcast_dict", "SELECT t.entity_id, coalesce(r.r_comment, t.value_code) AS name FROM entity_tags t LEFT JOIN (SELECT r_name, 'region ' || r_regionkey AS r_comment FROM region WHERE r_regionkey < 3) r ON t.value_code = r.r_name WHERE t.axis = 'geography'")
def join_broadcast_dict(g):
    """Display names of value codes; the dictionary is the region table of five rows."""
    names = g.table("region").where("r_regionkey < 3").select("r_name", F.concat(F.lit("region "), c("r_regionkey").cast("string")).alias("shown"))
    return g.tags.where("axis = 'geography'").join(F.broadcast(names), c("value_code") == c("r_name"), "left").select("entity_id", F.coalesce("shown", "value_code").alias("name"))


def all_trigrams(column):
    """Three-character runs of a column, in order. The text is cut into characters once: taking each run from the text would walk it anew."""
    cut = lambda ch: F.transform(F.sequence(F.lit(0), F.size(ch) - 3), lambda i: F.concat(F.get(ch, i), F.get(ch, i + 1), F.get(ch, i + 2)))
    return F.get(F.transform(F.array(F.split(column, "")), cut), 0)


#: Bytes of texts that a task looks through at a time, and numbers that short texts are known by before they are met.
LOOKED_AT, CODES = 1 << 20, 1 << 22


def _runs_of_shapes(shapes: dict[int, list[int]], looked_at: int):
    """Function of Arrow batches (id, long): each run of bytes that begins with three bytes, as one number, of the shapes and has a length that goes with them, as (id, short)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.array(sorted(shapes), np.int64)
        begins = np.zeros(1 << 24, bool)
        begins[heads] = True
        fits = {n: np.array([n in shapes[h] for h in heads.tolist()]) for n in sorted({n for ns in shapes.values() for n in ns})}
        for batch in batches:
            texts = batch["long"].cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at = 0
            while at < len(texts):
                # rows of some bytes, or one row that has more
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + looked_at, "right")) - 1)
                ends, data = bounds[at : to + 1] - bounds[at], np.frombuffer(texts.buffers()[2], np.uint8)[bounds[at] : bounds[to]]
                if len(data) >= 3:
                    three = data.astype(np.int32)
                    three = (three[:-2] << 16) | (three[1:-1] << 8) | three[2:]
                    starts = np.flatnonzero(begins[three])
                    head, row = np.searchsorted(heads, three[starts]), np.searchsorted(ends, starts, "right") - 1
                    room = ends[row + 1] - starts
                    for n, fit in fits.items():
                        chosen = np.flatnonzero(fit[head] & (room >= n))
                        first = starts[chosen]
                        # a run that ends inside a character is none
                        after = np.minimum(first + n, len(data) - 1)
                        whole = (first + n == ends[row[chosen] + 1]) | (data[after] & 0xC0 != 0x80)
                        chosen, first = chosen[whole], first[whole]
                        some = max(1, looked_at // n)
                        for i in range(0, len(first), some):
                            runs = data[first[i : i + some, None] + np.arange(n)]
                            text = pa.Array.from_buffers(pa.string(), len(runs), [None, pa.py_buffer(np.arange(0, runs.size + 1, n, dtype=np.int32)), pa.py_buffer(runs.tobytes())])
                            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row[chosen[i : i + some]] + at)), text], ["id", "short"])
                at = to

    return cut


def contained(short, long):
    """short (key, short), long (id, long) -> (key, id) where the long text holds the short one, of three characters or more; each pair once.

    Long texts do not leave the task that reads them, and are read once. What
    leaves it is runs of a short text's first three bytes and length, which
    are a dictionary however many texts there are; runs that no short text
    can be, by a number of it, go there too. The rest meet the short texts
    whole, as equal strings. Equal short texts are met once.
    """
    wanted = short.where(F.length("short") >= 3)
    # the first three bytes, as a number, and the length
    shape = wanted.select(F.conv(F.hex(F.substring(F.encode("short", "UTF-8"), 1, 3)), 16, 10).cast("int").alias("head"), F.octet_length("short").alias("n"))
    shapes: dict[int, list[int]] = {}
    for x in shape.distinct().collect():
        shapes.setdefault(x["head"], []).append(x["n"])
    held = long.where(F.length("long") >= 3).select("id", "long")
    kind = held.schema["id"].dataType.simpleString()
    code = F.pmod(F.xxhash64("short"), F.lit(CODES)).cast("int").alias("code")
    runs = held.mapInArrow(_runs_of_shapes(shapes, LOOKED_AT), f"id {kind}, short string").select("id", "short", code)
    found = runs.join(F.broadcast(wanted.select(code).distinct()), "code", "left_semi").select("id", "short").distinct()
    return wanted.join(found, "short").select("key", "id")


@query(
    "join_containment_prune",
    "SELECT DISTINCT n.word, e.id FROM (SELECT DISTINCT lower(p_name) AS word FROM part UNION SELECT DISTINCT lower(s_name) FROM supplier UNION SELECT lower(n_name) FROM nation) n JOIN entities e ON length(n.word) >= 3 AND contains(lower(e.label), n.word)",
)
def join_containment_prune(g):
    """Names, whole ones, that lie in labels."""
    name = lambda table, column: g.table(table).select(F.lower(column).alias("word"))
    names = name("part", "p_name").unionByName(name("supplier", "s_name")).unionByName(name("nation", "n_name")).distinct()
    return contained(names.select(c("word").alias("key"), c("word").alias("short")), g.entities.select("id", F.lower("label").alias("long"))).select(c("key").alias("word"), "id")


@query(
    "join_fuzzy",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT label, min(id) AS id FROM entities WHERE entity_type = 'work' GROUP BY label),
s AS (SELECT n.name, w.id, 1 - levenshtein(n.name, w.label) / CAST(greatest(length(n.name), length(w.label)) AS DOUBLE) AS sim FROM n JOIN w ON abs(length(n.name) - length(w.label)) <= 0.2 * greatest(length(n.name), length(w.label)))
SELECT name, id, CAST(floor(sim * 1e6 + 0.5) AS BIGINT) AS sim6 FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY floor(sim * 1e6 + 0.5) DESC, id) AS rn FROM s WHERE sim >= 0.8) t WHERE rn = 1""",
)
def join_fuzzy(g, at=0.8):
    """Best match of each name by 1 - edit distance / longer length."""
    names = g.table("part").select(c("p_name").alias("name")).distinct()
    works = g.entities.where("entity_type = 'work'").groupBy("label").agg(F.min("id").alias("id"))
    best = first_per(similar(names, works, at), ["name"], [F.desc("sim6"), "id"])
    return best.where("rn = 1").select("name", "id", "sim6")


def similar(names, works, at):
    """(name) with (label, id): all pairs of similarity ``at`` or more, as name, id, sim6.

    At most d = (1 - at) * longer length edits part such a pair. Cut into d + 1
    pieces, a label has one that the name holds unchanged, shifted by d places
    at most, so pairs meet on pieces and none is lost. Lengths of both sides
    are part of the key, and d of the longer one.
    """
    far = lambda a, b: F.floor(F.lit(1 - at) * F.greatest(a, b) + 1e-9).cast("int")
    length = names.select("name", F.length("name").alias("n")).where("n > 0")
    # the lengths that a partner may have
    sizes = length.withColumn("m", F.explode(F.sequence(F.ceil(c("n") * at - 1e-9).cast("int"), F.floor(c("n") / at + 1e-9).cast("int")))).withColumn("d", far(c("n"), c("m")))
    labels = works.select("id", "label", F.length("label").alias("m")).where("m > 0")
    wanted = labels.withColumn("n", F.explode(F.sequence(F.ceil(c("m") * at - 1e-9).cast("int"), F.floor(c("m") / at + 1e-9).cast("int")))).withColumn("d", far(c("n"), c("m")))
    begin = lambda i: F.floor(i * c("m") / (c("d") + 1)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), c("d")), lambda i: F.struct(i.alias("i"), begin(i).alias("b"), (begin(i + 1) - begin(i)).alias("k")))
    pieces = wanted.withColumn("s", F.explode(spans)).select("id", "label", "m", "n", "s.i", F.expr("substring(label, s.b + 1, s.k)").alias("piece"))
    tried = sizes.withColumn("s", F.explode(spans)).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), c("s.b") - c("d")), F.greatest(F.lit(0), F.least(c("n") - c("s.k"), c("s.b") + c("d"))))))
    probes = tried.select("name", "n", "m", "s.i", F.expr("substring(name, at + 1, s.k)").alias("piece")).distinct()
    cand = probes.join(pieces, ["n", "m", "i", "piece"]).select("name", "id", "label").distinct()
    sim = 1 - F.levenshtein("name", "label") / F.greatest(F.length("name"), F.length("label")).cast("double")
    return cand.withColumn("sim", sim).where(c("sim") >= at).select("name", "id", F.floor(c("sim") * 1e6 + 0.5).alias("sim6"))
