"""Readers of landed files: nested catalogues, query results, records in XML and CSV, map data, page manifests.

Each takes a path that Spark can read and returns flat rows. Schemas are
given, so no pass over the data infers them; malformed records give nulls and
are dropped where a key is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its whole text."""
    return spark.read.text(path, wholetext=True)


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """catalog_rows() of files."""
    return catalog_rows(documents(spark, path))


def catalog_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Arrays of nested catalogue records -> id, native, romaji, english, year (of the season, else of the start), format, genres, tags."""
    schema = "array<struct<id:long,title:struct<native:string,romaji:string,english:string>,format:string,seasonYear:int,startDate:struct<year:int>,genres:array<string>,tags:array<struct<name:string,rank:int>>>>"
    raw = texts.select(F.inline(F.from_json(text, schema)))
    return raw.where("id is not null").select("id", "title.native", "title.romaji", "title.english", F.coalesce("seasonYear", "startDate.year").alias("year"), "format", "genres", "tags")


def flatten_bindings(results: DataFrame, text: str = "value") -> DataFrame:
    """Query results {results: {bindings: [{col: {value}}]}} in a text column -> one map<column, value> row each."""
    schema = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
    parsed = results.select(F.explode(F.from_json(text, schema)["results"]["bindings"]).alias("b"))
    return parsed.select(F.transform_values("b", lambda _, v: v["value"]).alias("row"))


def bindings_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of query-result files."""
    rows = flatten_bindings(spark.read.text(path, wholetext=True))
    return rows.select(*[c("row")[x].alias(x) for x in columns])


def class_name(uri: Column) -> Column:
    """Last part of a class address, after # or /."""
    return F.substring_index(F.substring_index(uri, "/", -1), "#", -1)


def works_csv(spark: SparkSession, path: str, columns: dict[str, str], least: int = 10) -> DataFrame:
    """Works by header name; rows with fewer than ``least`` filled cells are dropped. columns: new name -> header."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    filled = sum((c(f"`{x}`").isNotNull().cast("int") for x in raw.columns), F.lit(0))
    return raw.where(filled >= min(least, len(raw.columns))).select(*[c(f"`{h}`").alias(n) for n, h in columns.items()])


def xml_records(spark: SparkSession, path: str, row_tag: str = "record", prefix: str = "dc:") -> DataFrame:
    """Library records -> title, creator, date, kind, identifier (the first of each) and all subjects in one string."""
    names = ("title", "creator", "date", "subject", "type", "identifier")
    inner = ",".join(f"`{prefix}{n}`:array<string>" for n in names)
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", False).schema(f"metadata struct<{inner}>").load(path)
    first = lambda n: F.get(c("metadata")[f"{prefix}{n}"], 0)
    subjects = F.array_join(c("metadata")[f"{prefix}subject"], " ")
    return raw.select(first("title").alias("title"), first("creator").alias("creator"), first("date").alias("date"), first("type").alias("kind"), first("identifier").alias("identifier"), subjects.alias("subjects")).where("title is not null")


def unescape(text: Column) -> Column:
    """The five named character references, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escaped_records(records: DataFrame, text: str = "payload") -> DataFrame:
    """Records whose payload is entity-escaped markup -> title (nested value, else text), creator, date (4 characters or more), identifier, subjects."""
    raw = records.withColumn("x", unescape(c(text)))
    one = lambda p: F.nullif(F.trim(F.regexp_extract("x", p, 1)), F.lit(""))
    title = F.coalesce(one("(?s)<dc:title>\\s*<rdf:Description>\\s*<rdf:value>([^<]*)</rdf:value>"), one("<dc(?:terms)?:title[^>]*>([^<]+)<"))
    date = one("<dc(?:terms)?:(?:date|issued)[^>]*>([^<]+)<")
    link = one("<link>([^<]+)</link>")
    subjects = F.regexp_extract_all("x", F.lit("<dc:subject[^>]*>([^<]+)<"), 1)
    return raw.select(title.alias("title"), one("<dc:creator[^>]*>([^<]+)<").alias("creator"), F.when(F.length(date) >= 4, date).alias("date"), F.coalesce(F.nullif(F.regexp_extract(link, "([0-9A-Za-z-]+)$", 1), F.lit("")), link).alias("identifier"), subjects.alias("subjects")).where("title is not null")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed items -> title (else dc:title), link (else guid), date."""
    schema = "title string, `dc:title` string, link string, guid string, pubDate string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return raw.select(F.coalesce("title", c("`dc:title`")).alias("title"), F.coalesce("link", "guid").alias("link"), c("pubDate").alias("date")).where("title is not null")


def language_tagged_json(spark: SparkSession, path: str) -> DataFrame:
    """language_tagged_rows() of files."""
    return language_tagged_rows(documents(spark, path))


def language_tagged_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Records, or arrays of them, with language-tagged names -> id, name_ja, name_en, creators."""
    tagged = "array<struct<`@language`:string,`@value`:string>>"
    one = f"struct<`@id`:string,`schema:name`:{tagged},`schema:creator`:{tagged}>"
    raw = texts.select(F.inline(F.from_json(F.when(F.ltrim(text).startswith("["), c(text)).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{one}>")))
    pick = lambda lang: F.get(F.filter(c("`schema:name`"), lambda n: n["@language"] == lang), 0)["@value"]
    return raw.select(c("`@id`").alias("id"), pick("ja").alias("name_ja"), pick("en").alias("name_en"), F.transform(c("`schema:creator`"), lambda n: n["@value"]).alias("creators"))


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """geojson_rows() of files."""
    return geojson_rows(documents(spark, path))


def geojson_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Features -> properties (map), kind, lat, lon: a point itself, a line's middle vertex, the mean of a polygon's first ring."""
    parsed = F.from_json(text, "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>")
    f = texts.select(F.explode(parsed["features"]).alias("f")).select("f.properties", c("f.geometry.type").alias("kind"), c("f.geometry.coordinates").alias("raw"))
    point = F.from_json("raw", "array<double>")
    line = F.from_json("raw", "array<array<double>>")
    ring = F.when(c("kind") == "Polygon", F.get(F.from_json("raw", "array<array<array<double>>>"), 0)).otherwise(F.get(F.get(F.from_json("raw", "array<array<array<array<double>>>>"), 0), 0))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + F.get(p, k)) / F.size(ring)
    middle = F.get(line, F.floor(F.size(line) / 2).cast("int"))
    at = lambda k: F.when(c("kind") == "Point", F.get(point, k)).when(c("kind") == "LineString", F.get(middle, k)).when(c("kind").isin("Polygon", "MultiPolygon"), mean(k))
    return f.select("properties", "kind", at(1).alias("lat"), at(0).alias("lon")).where("lat is not null and lon is not null")


def places_json(spark: SparkSession, path: str) -> DataFrame:
    """places_rows() of files."""
    return places_rows(documents(spark, path))


def places_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Map elements -> name, lat, lon, wikidata: own place, else the centre; Japanese name, else any, else English."""
    parsed = F.from_json(text, "struct<elements:array<struct<lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>")
    e = texts.select(F.explode(parsed["elements"]).alias("e")).select("e.*")
    name = F.coalesce(c("tags")["name:ja"], c("tags")["name"], c("tags")["name:en"])
    out = e.select(name.alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), c("tags")["wikidata"].alias("wikidata"))
    return out.where("name is not null and lat is not null and lon is not null")


def pages_manifest(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """manifest_rows() of files."""
    return manifest_rows(documents(spark, path), most=most)


def manifest_rows(texts: DataFrame, text: str = "value", most: int = 20) -> DataFrame:
    """A page manifest -> page, label, width, height, image, thumbnail of the first ``most`` pages."""
    canvas = "struct<label:string,width:int,height:int,images:array<struct<resource:struct<service:struct<`@id`:string>>>>>"
    raw = texts.select(F.from_json(text, f"struct<label:string,sequences:array<struct<canvases:array<{canvas}>>>>").alias("m")).select("m.*")
    p = raw.select(c("label").alias("title"), F.posexplode(F.get("sequences", 0)["canvases"]).alias("page", "k")).where(c("page") < most)
    image = F.get(c("k.images"), 0)["resource"]["service"]["@id"]
    return p.select("title", "page", "k.label", "k.width", "k.height", image.alias("image"), F.concat(image, F.lit("/full/200,/0/default.jpg")).alias("thumbnail"))


def ocr_pages(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """ocr_rows() of files."""
    return ocr_rows(documents(spark, path), most=most)


def ocr_rows(texts: DataFrame, text: str = "value", most: int = 20) -> DataFrame:
    """Recognised pages -> page, text: blocks joined by line breaks."""
    parsed = F.from_json(text, "struct<pages:array<struct<blocks:array<struct<text:string>>>>>")
    p = texts.select(F.posexplode(parsed["pages"]).alias("page", "p")).where(c("page") < most)
    return p.select("page", F.array_join(F.transform("p.blocks", lambda b: b["text"]), "\n").alias("text"))


#: Properties of outside ids and places, and the columns that they become.
KNOWN_PROPERTIES = {"P349": "ndl_id", "P4082": "madb_id", "P214": "viaf_id", "P213": "isni_id", "P18": "image", "P625": "coord"}

_CLAIM = "struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>"
_ENTITY = f"struct<id:string,labels:map<string,struct<value:string>>,claims:map<string,array<{_CLAIM}>>,sitelinks:map<string,struct<title:string>>>"


def entity_documents(texts: DataFrame, text: str = "value") -> DataFrame:
    """Entity documents -> id, labels, claims (property -> claims in order, of kind and value), sitelinks. An object among the values stays JSON text."""
    e = texts.select(F.from_json(text, _ENTITY).alias("e")).select("e.*").where("id is not null")
    data = lambda x: x["mainsnak"]["datavalue"]
    claims = F.transform_values("claims", lambda _, v: F.transform(v, lambda x: F.struct(data(x)["type"].alias("kind"), data(x)["value"].alias("value"))))
    return e.select("id", F.transform_values("labels", lambda _, v: v["value"]).alias("labels"), claims.alias("claims"), F.transform_values("sitelinks", lambda _, v: v["title"]).alias("sitelinks"))


def claim_value(kind: Column, value: Column) -> Column:
    """A typed claim as text: a string, an item's id, Point(lon,lat), else the value as it stands."""
    at = F.from_json(value, "struct<latitude:double,longitude:double>")
    axis = lambda x: F.coalesce(at[x], F.lit(0.0)).cast("string")
    return F.when(kind == "wikibase-entityid", F.get_json_object(value, "$.id")).when(kind == "globecoordinate", F.concat(F.lit("Point("), axis("longitude"), F.lit(","), axis("latitude"), F.lit(")"))).otherwise(value)


def first_claim(prop: str) -> Column:
    """The first claim of a property as text, null if there is none."""
    first = F.get(F.try_element_at("claims", F.lit(prop)), 0)
    return claim_value(first["kind"], first["value"])


def claim_columns(entities: DataFrame, properties: dict[str, str] = KNOWN_PROPERTIES) -> DataFrame:
    """id and a column for each known property: a pivot within the row, as each document holds all its claims."""
    return entities.select("id", *[first_claim(p).alias(name) for p, name in properties.items()])


def external_ids(entities: DataFrame) -> DataFrame:
    """id, labels, outside ids, link of the encyclopedia's article, and the coordinates."""
    label = lambda lang: F.coalesce(F.try_element_at("labels", F.lit(lang)), F.lit(""))
    title = F.try_element_at("sitelinks", F.lit("jawiki"))
    spot = F.get(F.try_element_at("claims", F.lit("P625")), 0)
    at = F.when(spot["kind"] == "globecoordinate", F.from_json(spot["value"], "struct<latitude:double,longitude:double>"))
    ids = [first_claim(p).alias(KNOWN_PROPERTIES[p]) for p in ("P4082", "P349", "P214")]
    return entities.select("id", label("ja").alias("label_ja"), label("en").alias("label_en"), *ids, F.concat(F.lit("http://ja.dbpedia.org/resource/"), title).alias("dbpedia_uri"), at["latitude"].alias("lat"), at["longitude"].alias("lon"))


# ---- sinks


def write_csv_reports(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_datasets(parts: dict[str, DataFrame], path: str, form: str = "json") -> None:
    """Several datasets in one write, a folder dataset=name for each; folders of other datasets stay.

    Each row is a JSON record of its own dataset's columns beside the name, so
    that one write holds datasets of different shapes.
    """
    rows = [df.select(F.lit(name).alias("dataset"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")) for name, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    form = "text" if form == "json" else form
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").format(form).save(path)


def write_geojson_lines(df: DataFrame, path: str, properties: list[str], tags: str | None = None) -> None:
    """Point features, one JSON object a line, coordinates as [lon, lat]; ``tags``: a map column that becomes the property tags."""
    named = [*properties, *([c(tags).alias("tags")] if tags else [])]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*named).alias("properties"))
    df.where("lat is not null and lon is not null").select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
