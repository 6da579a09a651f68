"""Sources and sinks over landed files: records of the tables are written in each shape, read by its reader, and shown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.stored import remove, shared_folder
from ..streaming import ingest
from ..streaming.index import labels_of_tokens, read_index
from .analytics import DATASET_KEYS, DATASET_SQL, dataset_frames, sink_datasets
from .registry import query

c = F.col
lit = F.lit


def landing(g) -> str:
    """A new folder below the one that all executors share; a local one only where that is unset."""
    base = shared_folder(g.spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/landed-{uuid.uuid4().hex}"


def landed(g, values: DataFrame, head: str = "", tail: str = "", between: str = "\n") -> str:
    """Write a text column, with head and tail as one document a file; returns the folder."""
    path = landing(g)
    if not head:
        values.write.text(path)
        return path
    files_ = max(64, values.count() // 2000)  # so many documents that each one stays small
    parts = values.withColumn("doc", F.pmod(F.xxhash64("value"), lit(files_)))
    docs = parts.groupBy("doc").agg(F.array_join(F.collect_list("value"), between).alias("body")).select("doc", F.concat(lit(head), "body", lit(tail)).alias("value"))
    docs.write.partitionBy("doc").text(path)
    return path


@query("src_catalog_json", "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS native, upper(p_name) AS english, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1900 + p_partkey % 100 ELSE 1800 + p_partkey % 100 END AS INT) AS year FROM part")
def src_catalog_json(g):
    """The year of the season, else of the start."""
    p = c("p_partkey")
    record = F.struct(p.alias("id"), F.struct(c("p_name").alias("native"), F.upper("p_name").alias("english")).alias("title"), F.when(p % 2 == 0, 1900 + p % 100).alias("seasonYear"), F.struct((1800 + p % 100).alias("year")).alias("startDate"))
    path = landing(g)
    g.table("part").select(F.concat(lit("["), F.to_json(record), lit("]")).alias("value")).write.text(path)
    return files.catalog_rows(g.spark.read.text(path)).select("id", "native", "english", "year")


@query("src_bindings_flatten", "SELECT qid, label FROM entities WHERE qid IS NOT NULL")
def src_bindings_flatten(g):
    bound = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(c("qid").alias("value")).alias("item"), F.struct(c("label").alias("value")).alias("name"))).alias("bindings")).alias("results")))
    path = landed(g, g.entities.where("qid is not null").select(bound.alias("value")))
    rows = files.flatten_bindings(g.spark.read.text(path))
    return rows.select(c("row")["item"].alias("qid"), c("row")["name"].alias("label"))


@query("src_works_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS maker FROM part")
def src_works_csv(g):
    path = landing(g)
    g.table("part").select(c("p_partkey").alias("no"), c("p_name").alias("name"), c("p_brand").alias("brand")).write.option("header", True).csv(path)
    return files.works_csv(g.spark, path, {"id": "no", "title": "name", "maker": "brand"}, least=3)


@query("src_xml_records", "SELECT p_name AS title, CAST(p_partkey AS VARCHAR) AS identifier, p_type || ' ' || p_brand AS subjects FROM part")
def src_xml_records(g):
    tag = lambda n, x: F.concat(lit(f"<dc:{n}>"), x, lit(f"</dc:{n}>"))
    record = F.concat(lit("<record><metadata xmlns:dc='d'>"), tag("title", c("p_name")), tag("identifier", c("p_partkey").cast("string")), tag("subject", c("p_type")), tag("subject", c("p_brand")), lit("</metadata></record>"))
    path = landed(g, g.table("part").select(record.alias("value")), "<records>", "</records>")
    return files.xml_records(g.spark, path).select("title", "identifier", "subjects")


@query("src_escaped_records", "SELECT p_name AS title, p_brand AS creator, CAST(1900 + p_partkey % 100 AS VARCHAR) AS date FROM part")
def src_escaped_records(g):
    tag = lambda n, x: F.concat(lit(f"&lt;dc:{n}&gt;"), x, lit(f"&lt;/dc:{n}&gt;"))
    body = F.concat(tag("title", c("p_name")), tag("creator", c("p_brand")), tag("date", (1900 + c("p_partkey") % 100).cast("string")))
    path = landed(g, g.table("part").select(body.alias("value")))
    return files.escaped_records(g.spark.read.text(path), "value").select("title", "creator", "date")


@query("src_feed_items", "SELECT s_name AS title, 'http://example.org/' || s_suppkey AS link FROM supplier")
def src_feed_items(g):
    """Title else its other name, link else the item's own address."""
    s = c("s_suppkey")
    name = F.when(s % 2 == 0, F.concat(lit("<title>"), c("s_name"), lit("</title>"))).otherwise(F.concat(lit("<dc:title xmlns:dc='d'>"), c("s_name"), lit("</dc:title>")))
    place = lambda n: F.concat(lit(f"<{n}>http://example.org/"), s.cast("string"), lit(f"</{n}>"))
    item = F.concat(lit("<item>"), name, F.when(s % 3 == 0, place("link")).otherwise(place("guid")), lit("</item>"))
    path = landed(g, g.table("supplier").select(item.alias("value")), "<rss>", "</rss>")
    return files.feed_items(g.spark, path).select("title", "link")


@query("src_langtagged_jsonld", "SELECT CAST(id AS VARCHAR) AS id, label AS name_ja, label_en AS name_en FROM entities WHERE label_en IS NOT NULL")
def src_langtagged_jsonld(g):
    name = lambda lang, x: F.struct(lit(lang).alias("@language"), x.alias("@value"))
    record = F.struct(c("id").cast("string").alias("@id"), F.array(name("en", c("label_en")), name("ja", c("label"))).alias("schema:name"))
    path = landed(g, g.entities.where("label_en is not null").select(F.to_json(record).alias("value")))
    return files.language_tagged_rows(g.spark.read.text(path)).select("id", "name_ja", "name_en")


@query(
    "src_geojson_points",
    """SELECT CAST(id AS VARCHAR) AS id, kind, CAST(floor((lat + dy) * 1e6 + 0.5) AS BIGINT) AS lat6, CAST(floor((lon + dx) * 1e6 + 0.5) AS BIGINT) AS lon6 FROM (
SELECT id, lat, lon, (['Point', 'LineString', 'Polygon', 'MultiPolygon'])[id % 4 + 1] AS kind, ([0, 0.5, 0.125, 0.25])[id % 4 + 1] AS dy, ([0, 1.5, 0.25, 0.5])[id % 4 + 1] AS dx FROM entities WHERE lat IS NOT NULL) t""",
)
def src_geojson_points(g):
    """Points of the four kinds of geometry: a point itself, the middle vertex of a line, the mean of the first ring of a polygon or of the first of several."""
    at = lambda dx, dy: F.array(c("lon") + dx, c("lat") + dy)
    ring = lambda w, h: F.array(at(0.0, 0.0), at(w, 0.0), at(w, h), at(0.0, h))
    hole = F.array(at(9.0, 9.0), at(9.5, 9.0), at(9.5, 9.5))
    shapes = [("Point", at(0.0, 0.0)), ("LineString", F.array(at(0.5, 0.25), at(1.0, 0.25), at(1.5, 0.5), at(2.0, 2.0))), ("Polygon", F.array(ring(0.5, 0.25), hole)), ("MultiPolygon", F.array(F.array(ring(1.0, 0.5)), F.array(hole)))]
    feature = lambda kind, x: F.to_json(F.struct(F.array(F.struct(F.struct(c("id").cast("string").alias("id")).alias("properties"), F.struct(lit(kind).alias("type"), x.alias("coordinates")).alias("geometry"))).alias("features")))
    value = None
    for i, (kind, x) in enumerate(shapes):
        mine = c("id") % 4 == i
        value = F.when(mine, feature(kind, x)) if value is None else value.when(mine, feature(kind, x))
    path = landed(g, g.entities.where("lat is not null").select(value.alias("value")))
    whole = lambda x: F.floor(c(x) * 1e6 + 0.5)
    return files.geojson_rows(g.spark.read.text(path)).select(c("properties")["id"].alias("id"), "kind", whole("lat").alias("lat6"), whole("lon").alias("lon6"))


def _entity_documents(g):
    """Documents of the parts as entities: outside ids as strings or items, a place, a date, and the title of an article."""
    data = lambda kind, value: F.array(F.struct(F.struct(F.struct(lit(kind).alias("type"), value.alias("value")).alias("datavalue")).alias("mainsnak")))
    text = lambda head: F.concat(lit(head), c("p_partkey").cast("string"))
    claim = lambda prop, on, kind, value: F.when(on, F.concat(lit(f'"{prop}":'), F.to_json(data(kind, value))))
    key, spot = c("p_partkey"), F.struct((c("p_size") * 0.5).alias("latitude"), (c("p_size") * 0.25 + 100).alias("longitude"))
    claims = F.concat_ws(
        ",",
        claim("P349", key % 2 == 0, "string", text("ndl-")),
        claim("P4082", key % 3 == 0, "wikibase-entityid", F.struct(text("Q9").alias("id"))),
        claim("P214", key % 5 < 3, "string", text('v"')),
        claim("P213", key % 7 == 0, "quantity", F.struct(text("+").alias("amount"))),
        claim("P625", key % 4 == 0, "globecoordinate", spot),
    )
    labels = F.struct(F.when(key % 6 != 0, F.struct(c("p_name").alias("value"))).alias("ja"), F.struct(F.upper("p_name").alias("value")).alias("en"))
    links = F.struct(F.when(key % 2 == 1, F.struct(c("p_name").alias("title"))).alias("jawiki"))
    whole = F.concat(lit('{"id":"'), text("Q"), lit('","labels":'), F.to_json(labels), lit(',"claims":{'), claims, lit('},"sitelinks":'), F.to_json(links), lit("}"))
    return files.entity_documents(g.spark.read.text(landed(g, g.table("part").select(whole.alias("value")))))


_IDS_SQL = """SELECT 'Q' || p_partkey AS id, p_partkey AS k, p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'ndl-' || p_partkey END AS ndl_id, CASE WHEN p_partkey % 3 = 0 THEN 'Q9' || p_partkey END AS madb_id,
CASE WHEN p_partkey % 5 < 3 THEN 'v"' || p_partkey END AS viaf_id, CASE WHEN p_partkey % 7 = 0 THEN '{"amount":"+' || p_partkey || '"}' END AS isni_id FROM part"""


@query("src_claim_value", f"SELECT id, ndl_id, madb_id, viaf_id, isni_id, CAST(NULL AS VARCHAR) AS image, CASE WHEN k % 4 = 0 THEN 'Point(' || CAST(p_size * 0.25 + 100 AS DOUBLE) || ',' || CAST(p_size * 0.5 AS DOUBLE) || ')' END AS coord FROM ({_IDS_SQL}) t")
def src_claim_value(g):
    """Entity documents with a column for each known property, every kind of value as text."""
    return files.claim_columns(_entity_documents(g))


@query(
    "src_external_ids",
    f"""WITH t AS ({_IDS_SQL}), r AS (SELECT id, CASE WHEN k % 6 <> 0 THEN p_name ELSE '' END AS label_ja, upper(p_name) AS label_en, madb_id, ndl_id, viaf_id, CASE WHEN k % 2 = 1 THEN 'http://ja.dbpedia.org/resource/' || p_name END AS dbpedia_uri,
CASE WHEN k % 4 = 0 THEN CAST(p_size * 0.5 AS DOUBLE) END AS lat, CASE WHEN k % 4 = 0 THEN CAST(p_size * 0.25 + 100 AS DOUBLE) END AS lon FROM t)
SELECT r.*, (SELECT count(madb_id) FROM r) AS with_madb, (SELECT count(ndl_id) FROM r) AS with_ndl, (SELECT count(viaf_id) FROM r) AS with_viaf, (SELECT count(lat) FROM r) AS with_place FROM r""",
)
def src_external_ids(g):
    """Labels, outside ids, article and place of each entity document, and how many have each."""
    rows = files.external_ids(_entity_documents(g))
    counts = rows.agg(*[F.count(x).alias(f"with_{n}") for x, n in (("madb_id", "madb"), ("ndl_id", "ndl"), ("viaf_id", "viaf"), ("lat", "place"))])
    return rows.join(F.broadcast(counts))  # one row


@query("src_places_json", "SELECT label AS name, lat, lon FROM entities WHERE lat IS NOT NULL AND label IS NOT NULL")
def src_places_json(g):
    """An element's own place, else its centre."""
    own = c("id") % 2 == 0
    element = F.struct(F.when(own, c("lat")).alias("lat"), F.when(own, c("lon")).alias("lon"), F.struct("lat", "lon").alias("center"), F.struct(c("label").alias("name")).alias("tags"))
    path = landed(g, g.entities.where("lat is not null").select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value")))
    return files.places_rows(g.spark.read.text(path)).select("name", "lat", "lon")


_TURN_PAGES = "SELECT CAST(conv_id AS VARCHAR) AS title, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, text FROM conversations"


def _pages(g, page):
    """A document for each conversation, a page for each turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), page)
    return g.table("conversations").groupBy("conv_id").agg(turns.alias("pages"))


@query("src_pages_manifest", f"SELECT title, CAST(page AS INT) AS page, CAST(turn AS VARCHAR) AS label, 'http://example.org/' || turn AS image FROM ({_TURN_PAGES}) t WHERE page < 20")
def src_pages_manifest(g):
    at = lambda t: F.concat(lit("http://example.org/"), t["turn"].cast("string"))
    image = lambda t: F.struct(F.struct(F.struct(at(t).alias("@id")).alias("service")).alias("resource"))
    books = _pages(g, lambda t: F.struct(t["turn"].cast("string").alias("label"), F.array(image(t)).alias("images")))
    manifest = F.struct(c("conv_id").cast("string").alias("label"), F.array(F.struct(c("pages").alias("canvases"))).alias("sequences"))
    path = landed(g, books.select(F.to_json(manifest).alias("value")))
    return files.manifest_rows(g.spark.read.text(path)).select("title", "page", "label", "image")


@query("src_ocr_pages", f"SELECT CAST(page AS INT) AS page, text || chr(10) || 'end' AS text FROM ({_TURN_PAGES}) t WHERE page < 20")
def src_ocr_pages(g):
    books = _pages(g, lambda t: F.struct(F.array(F.struct(t["text"].alias("text")), F.struct(lit("end").alias("text"))).alias("blocks")))
    path = landed(g, books.select(F.to_json(F.struct("pages")).alias("value")))
    return files.ocr_rows(g.spark.read.text(path)).select("page", "text")


_WRITTEN_SQL = " UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS n, count(DISTINCT ({', '.join(key)})) AS keys, md5(string_agg(CAST({key[0]} AS VARCHAR), ',' ORDER BY {', '.join(key)})) AS ids FROM ({DATASET_SQL[name]}) t" for name, key in DATASET_KEYS.items())


@query("sink_dataset", _WRITTEN_SQL)
def sink_dataset_query(g):
    """All four datasets in one write by name, then one of them alone again: the others stay as they were. What each folder holds."""
    path = landing(g)
    sink_datasets(g, path)
    sink_datasets(g, path, ["geo"])
    out = None
    for name, df in dataset_frames(g).items():
        key = DATASET_KEYS[name]
        rows = g.spark.read.text(f"{path}/dataset={name}").select(F.from_json("value", df.schema).alias("r")).select("r.*")
        ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*key))), _field(key[0])), ",")
        one = rows.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("keys"), F.md5(ids).alias("ids")).select(lit(name).alias("dataset"), "n", "keys", "ids")
        out = one if out is None else out.unionByName(one)
    return out


def _field(name):
    return lambda x: x[name].cast("string")


@query("sink_csv_reports", "SELECT source, entity_type, CAST(count(*) AS VARCHAR) AS n FROM entities GROUP BY source, entity_type")
def sink_csv_reports(g):
    path = landing(g)
    files.write_csv_reports(g.entities.groupBy("source", "entity_type").agg(F.count("*").alias("n")), path)
    return g.spark.read.option("header", True).csv(path)


@query(
    "sink_geojson",
    "WITH t AS (SELECT entity_id, string_agg(axis || '=' || v, ';' ORDER BY axis) AS tags FROM (SELECT entity_id, axis, string_agg(value_code, ',' ORDER BY value_code) AS v FROM entity_tags GROUP BY 1, 2) q GROUP BY 1) SELECT id, entity_type, lon, lat, coalesce(t.tags, '') AS tags FROM entities LEFT JOIN t ON t.entity_id = id WHERE lat IS NOT NULL",
)
def sink_geojson(g):
    """Features with id, type and the tags by axis; read back with the tags in one string."""
    path = landing(g)
    values = g.tags.groupBy("entity_id", "axis").agg(F.array_join(F.sort_array(F.collect_list("value_code")), ",").alias("v"))
    tags = values.groupBy(c("entity_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("axis", "v"))).alias("tags"))
    rows = g.entities.where("lat is not null").select("id", "entity_type", "lat", "lon").join(tags, "id", "left")
    files.write_geojson_lines(rows, path, ["id", "entity_type"], tags="tags")
    got = g.spark.read.text(path).select(F.from_json("value", "geometry struct<coordinates:array<double>>, properties struct<id:long,entity_type:string,tags:map<string,string>>").alias("f"))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("f.properties.tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return got.select("f.properties.id", "f.properties.entity_type", c("f.geometry.coordinates")[0].alias("lon"), c("f.geometry.coordinates")[1].alias("lat"), F.coalesce(line, lit("")).alias("tags"))


def _stream(g):
    """Labels of all entities as arriving files, ingested twice and then removed; returns the folder of the store."""
    inbox, store, marks = landing(g), landing(g), landing(g)
    g.entities.where("label is not null").select("id", "label", "source", lit("2024-01-01T00:00:00").alias("seen"), "lat", "lon").write.json(inbox)
    for _ in range(2):
        ingest.ingest_new_labels(g.spark, inbox, store, marks).awaitTermination()
    remove(g.spark, inbox)
    return store


@query("stream_ingest_dedupe", "SELECT DISTINCT trim(lower(label)) AS key FROM entities WHERE trim(lower(label)) <> ''")
def stream_ingest_dedupe(g):
    """Each label once, though its files are offered twice."""
    return g.spark.read.parquet(_stream(g)).select("key")


@query(
    "stream_index_refresh",
    """WITH l AS (SELECT DISTINCT trim(lower(label)) AS k FROM entities), s AS (SELECT k, unnest(range(1, length(k) - 1)) AS i FROM l WHERE length(k) >= 3),
o AS (SELECT trim(lower(label)) AS k, count(*) AS n, min(lat) AS lat, min(lon) AS lon FROM entities WHERE trim(lower(label)) <> '' GROUP BY 1)
SELECT 'gram' AS part, substr(k, CAST(i AS INT), 3) AS key, count(DISTINCT k) AS n FROM s GROUP BY 2
UNION ALL SELECT 'cell', CAST(CAST(floor(lat / 0.25) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon / 0.25) AS BIGINT) AS VARCHAR), count(*) FROM o WHERE n = 1 AND lat IS NOT NULL GROUP BY 2""",
)
def stream_index_refresh(g):
    """Labels of each gram, and places of labels that stand once of each cell, from the index that a second stream keeps in batches."""
    store, index, marks = _stream(g), landing(g), landing(g)
    parts = max(1, len(g.spark.read.parquet(store).inputFiles()))
    ingest.refresh_index(g.spark, store, index, marks, files=-(-parts // 3)).awaitTermination()
    remove(g.spark, store)
    grams = labels_of_tokens(g.spark, index).select(c("token").alias("key"), "n")
    once = g.entities.where(ingest.key_of("label") != "").groupBy(ingest.digest_of("label").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id")
    cells = read_index(g.spark, index, "grid").join(once, "id", "left_semi").groupBy(F.concat_ws(":", "cy", "cx").alias("key")).agg(F.count("*").alias("n"))
    return grams.select(lit("gram").alias("part"), "key", "n").unionByName(cells.select(lit("cell").alias("part"), "key", "n"))
