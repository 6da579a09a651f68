"""Operators against brute force, and the extension points."""

import random

from pyspark.sql import functions as F

from kumihimo.functions import rules
from kumihimo.plans import analytics, generators
from kumihimo.plans.enrichment import keyword_themes, located
from kumihimo.plans.joins import all_trigrams, similar
from kumihimo.plans import text_index
from kumihimo.plans.search import trigram_hits
from kumihimo.sources.graph import Graph

FOLDER = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_join_loses_no_pair(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n))
    names = [*{word(r.randint(1, 24)) for _ in range(60)}, "abcde", "é日本語x"]
    labels = [*names[:20], "abXde", "é日本五x"]
    for n in names[20:50]:
        s = list(n)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(s) + 1)
            s[k : k + r.randint(0, 1)] = r.choice(["", "z", "a"])
        labels.append("".join(s) or "q")
    got = {(x["name"], x["id"]) for x in similar(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(labels)), "id long, label string"), 0.8).collect()}
    want = {(a, i) for a in names for i, b in enumerate(labels) if 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12}
    assert got == want and len(want) > 30


def test_trigrams_of_wide_and_long_texts(spark):
    texts = ["ab", "abc", "a🙂bc", "日本語です", "x" * 200_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").where("length(t) >= 3")
    got = sorted(tuple(x[0]) for x in df.select(all_trigrams(F.col("t"))).collect())
    assert got == sorted(tuple(t[i : i + 3] for i in range(len(t) - 2)) for t in texts[1:])


def test_stored_index_gives_the_same_hits_as_a_scan(spark):
    """All hits of a keyword in the label, by positions in the index and by reading the labels."""
    g = Graph(spark, FOLDER)
    index = text_index.index_of(g, "grams")
    for word in ("able", "STEEL", "nnn", "of the"):
        found = index.phrase(text_index.tokens_of(spark, word, "grams")).where("field = 'label'")
        assert sorted(x["id"] for x in found.select("id").collect()) == sorted(x["id"] for x in trigram_hits(g, word).select("id").collect())


def test_route_fill_is_the_first_in_the_box(spark):
    g = Graph(spark, FOLDER)
    middle = [(1, 34.9, 136.1), (2, 35.6, 135.2), (3, 30.0, 130.0)]
    got = analytics._first_in_box(g, spark.createDataFrame([(w, y, x, 3) for w, y, x in middle], "work long, mid_lat double, mid_lon double, has long"), 0.5, 4).collect()
    art = sorted((x["id"], x["lat"], x["lon"]) for x in g.entities.where("entity_type = 'artifact' and is_dormant = 0 and lat is not null").collect())
    for w, y, x in middle:
        want = [i for i, a, b in art if abs(a - y) <= 0.5 and abs(b - x) <= 0.5][:4]
        assert sorted(r["id"] for r in got if r["work"] == w)[:4] == want


def test_added_rules_and_generators(spark):
    g = Graph(spark, FOLDER)
    rules.register_rule("short", F.length("label") < 12)
    generators.register_generator("first_two", lambda entities, tags, edges: entities.where("entity_type = 'person'").select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")))
    try:
        flagged = rules.flagged(g.entities).collect()
        assert all((x["flags"] == ["short"]) == (len(x["label"]) < 12) for x in flagged)
        from kumihimo.plans.registry import QUERIES

        assert not any(len(x["label"]) < 12 for x in QUERIES["job_filter_blocklist"](spark, FOLDER).join(g.entities.select("id", "label"), "id").collect())
        pairs = generators.registered_pairs(g).collect()
        assert pairs and all(x["generator"] == "first_two" and x["b_id"] == x["a_id"] + 1 for x in pairs)
    finally:
        rules.EXTRA.clear()
        generators.EXTRA.clear()
    assert generators.registered_pairs(g).count() == 0


def test_themes_and_places_named_by_labels(spark):
    df = spark.createDataFrame([(1, "桜の城", "place"), (2, "plain", "work"), (3, "plain", "person"), (4, "東京都の寺", "place"), (5, "土佐日記 神奈川", "work"), (6, "薩摩焼", "work")], "id long, label string, kind string")
    got = {x["id"]: set(x["t"]) for x in df.select("id", keyword_themes(F.col("label"), F.col("kind")).alias("t")).collect()}
    assert got == {1: {"war_conflict", "seasonal_beauty"}, 2: {"craft_mastery"}, 3: set(), 4: {"sacred_profane"}, 5: {"nature_communion"}, 6: {"craft_mastery"}}
    places = {x["id"]: x["place"] for x in located(df).collect()}
    assert places == {4: "東京", 5: "神奈川", 6: "薩摩"}


def test_heritage_rank_of_odd_rows(spark, tmp_path):
    """Rows without an order were taken before those with one, and numbers outside the list of designations ended the job."""
    import duckdb

    from kumihimo.plans import registry

    rows = "(1, 7, NULL, 1999), (1, 7, 5, 2000), (1, 7, 9, 2001), (2, 1, NULL, 1998), (2, 3, 4, 1997), (3, 0, 1, 1999), (3, 8, 2, 1999), (3, 9, 3, 1999), (3, -9, 4, 1999), (4, -8, 1, 2001), (4, 2, 0, 1998), (5, -2, 1, 2100), (NULL, 6, 1, 1990), (6, NULL, 1, 1990)"
    lines = f"SELECT p AS l_partkey, n AS l_linenumber, o AS l_orderkey, make_timestamp(y, 1, 2, 0, 0, 0.0) AS l_shipdate FROM (VALUES {rows}) v(p, n, o, y)"
    duckdb.sql(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(registry.ORACLES["job_heritage_rank"]).fetchall()
    got = [(x["item"], x["heritage"], x["year"]) for x in registry.QUERIES["job_heritage_rank"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (1, "registered_tangible", 2000) in got and len(got) == 5
