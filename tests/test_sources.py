"""Readers on small landed files, sinks, streams."""

import json

from pyspark.sql import functions as F

from kumihimo.sources import files
from kumihimo.streaming import index as stream_index
from kumihimo.streaming import ingest


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_catalog(spark, tmp_path):
    body = [{"id": 1, "title": {"native": "題", "romaji": "Dai"}, "seasonYear": None, "startDate": {"year": 1999}, "format": "TV", "genres": ["Drama"], "tags": [{"name": "x", "rank": 40}]}, {"title": {}}]
    row = files.catalog_json(spark, write(tmp_path, "c.json", body)).collect()
    assert len(row) == 1 and (row[0]["native"], row[0]["year"]) == ("題", 1999)


def test_bindings(spark, tmp_path):
    body = {"results": {"bindings": [{"item": {"value": "http://x/Q1"}, "name": {"value": "a"}}, {"item": {"value": "http://x/Q2"}}]}}
    rows = files.bindings_json(spark, write(tmp_path, "b.json", body), ["item", "name"]).collect()
    assert [(r["item"], r["name"]) for r in rows] == [("http://x/Q1", "a"), ("http://x/Q2", None)]
    assert spark.range(1).select(files.class_name(F.lit("http://x/y#Book"))).first()[0] == "Book"


def test_csv(spark, tmp_path):
    path = write(tmp_path, "w.csv", "id,name,year\n1,a,1900\n2,,\n")
    assert [r["title"] for r in files.works_csv(spark, path, {"title": "name"}, least=3).collect()] == ["a"]


def test_xml_and_feed(spark, tmp_path):
    xml = "<l xmlns:dc='d'><record><metadata><dc:title>T</dc:title><dc:subject>a</dc:subject><dc:subject>b</dc:subject></metadata></record><record><metadata><dc:creator>x</dc:creator></metadata></record></l>"
    rows = files.xml_records(spark, write(tmp_path, "r.xml", xml)).collect()
    assert [(r["title"], r["subjects"]) for r in rows] == [("T", "a b")]
    feed = "<rss xmlns:dc='d'><item><title>A</title><guid>g</guid></item><item><dc:title>B</dc:title><link>l</link></item></rss>"
    assert [(r["title"], r["link"]) for r in files.feed_items(spark, write(tmp_path, "f.xml", feed)).collect()] == [("A", "g"), ("B", "l")]


def test_escaped_records(spark):
    body = "&lt;dc:title&gt;Old &amp;amp; new&lt;/dc:title&gt;&lt;dc:date&gt;1930&lt;/dc:date&gt;&lt;link&gt;http://x/R7&lt;/link&gt;&lt;dc:subject&gt;s&lt;/dc:subject&gt;"
    row = files.escaped_records(spark.createDataFrame([(body,), (None,)], "payload string")).collect()
    assert len(row) == 1
    assert (row[0]["title"], row[0]["date"], row[0]["identifier"], row[0]["subjects"]) == ("Old &amp; new", "1930", "R7", ["s"])


def test_maps(spark, tmp_path):
    geo = {"features": [{"properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [135.0, 35.0]}}, {"properties": {"n": "l"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4], [5, 6]]}}, {"properties": {"n": "g"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}]}
    got = {r["properties"]["n"]: (r["lat"], r["lon"]) for r in files.geojson_points(spark, write(tmp_path, "g.json", geo)).collect()}
    assert got == {"p": (35.0, 135.0), "l": (4.0, 3.0), "g": (1.0, 1.0)}
    places = {"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "b", "name:ja": "あ"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"name:en": "c"}}, {"tags": {"name": "x"}}]}
    assert [(r["name"], r["lat"]) for r in files.places_json(spark, write(tmp_path, "p.json", places)).collect()] == [("あ", 1.0), ("c", 3.0)]


def test_pages(spark, tmp_path):
    body = {"label": "book", "sequences": [{"canvases": [{"label": str(i), "width": 1, "height": 2, "images": [{"resource": {"service": {"@id": f"http://i/{i}"}}}]} for i in range(25)]}]}
    rows = files.pages_manifest(spark, write(tmp_path, "m.json", body)).collect()
    assert len(rows) == 20 and rows[3]["image"] == "http://i/3"
    ocr = {"pages": [{"blocks": [{"text": "a"}, {"text": "b"}]}]}
    assert files.ocr_pages(spark, write(tmp_path, "o.json", ocr)).first()["text"] == "a\nb"
    tagged = [{"@id": "1", "schema:name": [{"@language": "ja", "@value": "題"}, {"@language": "en", "@value": "T"}], "schema:creator": []}]
    row = files.language_tagged_json(spark, write(tmp_path, "t.json", tagged)).first()
    assert (row["name_ja"], row["name_en"]) == ("題", "T")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 35.0, 135.0), (2, None, None)], "id long, lat double, lon double")
    files.write_geojson_lines(df, str(tmp_path / "geo"), ["id"])
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert [x["geometry"]["coordinates"] for x in lines] == [[135.0, 35.0]]
    files.write_csv_reports(df.select("id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_streams_append_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    row = lambda i, label: json.dumps({"id": i, "label": label, "source": "s", "seen": "2024-01-01T00:00:00"})
    (inbox / "1.json").write_text("\n".join([row(1, "Alpha"), row(2, "alpha "), row(3, "Beta")]))
    store, index = str(tmp_path / "store"), str(tmp_path / "index")

    def both():
        ingest.ingest_new_labels(spark, str(inbox), store, str(tmp_path / "c1")).awaitTermination()
        ingest.refresh_index(spark, store, index, str(tmp_path / "c2")).awaitTermination()

    both()
    both()
    (inbox / "2.json").write_text("\n".join([row(4, "ALPHA"), row(5, "Gamma")]))
    both()
    assert sorted(r["key"] for r in spark.read.parquet(store).collect()) == ["alpha", "beta", "gamma"]
    assert stream_index.with_token(spark, index, "amm", 16).count() == 1


def test_ids_of_kinds_stay_apart_at_any_scale(spark, tmp_path):
    """Keys beyond a million: people, places, works and documents share no id, and types are told by it."""
    from kumihimo.sources.graph import Graph

    source = "/root/testdata/sf0.001"
    more = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "documents": "doc_id"}
    for table, key in more.items():
        rows = spark.read.parquet(f"{source}/{table}.parquet").limit(50)
        rows.withColumn(key, F.col(key) + 999_990 * (F.col(key) % 3)).write.parquet(str(tmp_path / f"{table}.parquet"))
    e = Graph(spark, str(tmp_path)).entities.select("id", "entity_type")
    assert e.count() == e.select("id").distinct().count()
    kinds = {r["k"]: r["t"] for r in e.groupBy(F.floor(F.col("id") / 10**12).alias("k")).agg(F.collect_set("entity_type").alias("t")).collect()}
    assert kinds == {1: ["person"], 2: ["place"], 3: ["work"], 4: ["artifact"]}
