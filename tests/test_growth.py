"""Queries whose work grows with the tables: repeated names, places and nodes are met once, and results stay those of direct computation."""

from collections import Counter

import duckdb
import pytest

from kumihimo.plans import registry
from tests.test_queries import FOLDER, TABLES, _plain


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    relation = con.sql(registry.ORACLES[name])
    names, columns = sorted(df.columns), list(relation.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(r[columns.index(n)]) for n in names) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def tripled(tmp_path_factory):
    """The smallest tables, each row three times under keys of its own: names and places repeat."""
    folder = tmp_path_factory.mktemp("tripled")
    shifted = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "documents": ["doc_id"]}
    for t in TABLES:
        keys = ", ".join(f"{k} + 100000 * i AS {k}" for k in shifted.get(t, []))
        rows = f"SELECT t.* REPLACE ({keys}) FROM '{FOLDER}/{t}.parquet' t, range(3) r(i)" if keys else f"SELECT * FROM '{FOLDER}/{t}.parquet'"
        duckdb.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet'")
    return folder


def largest_join(df):
    """Most rows that a join of the plan has put out."""
    df.collect()
    most, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        plan = open_.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            open_.append(plan.executedPlan())
            continue
        if plan.nodeName().endswith("QueryStage"):
            open_.append(plan.plan())
            continue
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return most


def test_fallback_chain_meets_a_title_once(spark, tripled):
    compare(spark, tripled, "join_fallback_chain")
    assert largest_join(registry.QUERIES["join_fallback_chain"](spark, str(tripled))) <= 600


def test_rule_candidates_join_pairs_with_edges_alone(spark, tripled):
    compare(spark, tripled, "gen_rule_candidates")
    compare(spark, tripled, "gen_same_era_cross_medium")
    # tags of pairs came from two joins; one is left, that with edges
    plan = registry.QUERIES["gen_rule_candidates"](spark, str(tripled))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "Join Inner, (x#" not in plan and "Join Inner, (y#" not in plan


@pytest.mark.parametrize("deep", [1, 3, 64])
def test_route_fill_is_whole_at_any_depth(spark, deep):
    """Least ids in a box, with lists that end too early too, against direct computation."""
    import random

    from pyspark.sql import functions as F

    from kumihimo.plans.analytics import _first_found

    r = random.Random(deep)
    places = [(i, 34 + r.randrange(200) / 100, 135 + r.randrange(40) / 20) for i in range(900)]

    class G:
        entities = spark.createDataFrame(places, "id long, lat double, lon double").withColumns({"entity_type": F.lit("artifact"), "is_dormant": F.lit(0)})

    G.spark = spark
    middle = [(w, 33.8 + r.random() * 2.4, 134.8 + r.random() * 2.4) for w in range(60)] + [(99, 0.0, 0.0)]
    df = _first_found(G, spark.createDataFrame(middle, "work long, mid_lat double, mid_lon double"), 0.5, 4, deep)
    got = {x["work"]: [p["place"] for p in x["found"]] for x in df.collect() if x["found"]}
    want = {w: sorted(i for i, a, b in places if abs(a - y) <= 0.5 and abs(b - x) <= 0.5)[:4] for w, y, x in middle}
    assert got == {w: ids for w, ids in want.items() if ids}


def test_routes_of_a_batch_as_one_by_one(spark):
    import random

    import pandas as pd
    import pyarrow as pa

    from kumihimo.functions.routes import nearest_first, routes_in_order

    r = random.Random(3)
    routes = [(w, [(p, r.randrange(4) / 10, r.randrange(4) / 10) for p in sorted(r.sample(range(100), w % 21))]) for w in range(200)]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64())]))
    stops = pa.array([[dict(zip(("place", "lat", "lon"), p, strict=True)) for p in ps] for _, ps in routes], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in routes]), stops], names=["work", "stops"])
    got = sorted(tuple(x.values()) for out in routes_in_order(iter([batch, batch.slice(7, 30)])) for x in out.to_pylist())
    one = [tuple(int(v) for v in x) for w, ps in routes if ps for x in nearest_first(pd.DataFrame([(w, *p) for p in ps], columns=["work", "place", "lat", "lon"])).itertuples(index=False)]
    assert got == sorted(one + [x for x in one if 7 <= x[0] < 37])


@pytest.mark.parametrize("name", ["text_title_containment", "join_containment_prune"])
def test_containment_leaves_grams_in_their_task(spark, tripled, name):
    """Every trigram of every label was shuffled; now chosen ones are."""
    compare(spark, tripled, name)
    df = registry.QUERIES[name](spark, str(tripled))
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in text


@pytest.mark.parametrize("name", ["gen_proximity_deg", "gen_proximity_1km", "gen_proximity_500m"])
def test_near_pairs_are_not_shuffled(spark, tripled, name):
    compare(spark, tripled, name)
    df = registry.QUERIES[name](spark, str(tripled))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # pairs were made distinct, and then joined with edges
    assert "Aggregate" not in plan.split("Join Inner")[0] and "LeftAnti" not in plan


@pytest.mark.parametrize("block", [1, 5])
def test_near_pairs_in_blocks(spark, block):
    """A place with many members, met in blocks; pairs that have an edge are left out."""
    from pyspark.sql import functions as F

    from kumihimo.plans.generators import new_near

    rows = [(i, 35.0, 135.0 + (i % 7 == 0), None if i % 2 else "k") for i in range(40)]

    class G:
        edges = spark.createDataFrame([(1, 2), (0, 7), (3, 33)], "a_id long, b_id long")

    placed = spark.createDataFrame(rows + rows[:3], "id long, lat double, lon double, kind string")
    pairs = spark.createDataFrame([(35.0, 135.0) * 2, (35.0, 136.0) * 2], "a_lat double, a_lon double, b_lat double, b_lon double")
    got = sorted(tuple(x) for x in new_near(G, placed, pairs, F.expr("a_lat = b_lat and a_lon = b_lon"), block).collect())
    fit = lambda x, y: x[2] == y[2] and not (x[3] and y[3]) and (x[0], y[0]) not in {(1, 2), (0, 7), (3, 33)}
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and fit(x, y))


@pytest.mark.parametrize("name", ["join_semi", "join_anti", "gen_isolated_nearest", "gen_unlinked_nearest"])
def test_semi_joins_take_each_node_once(spark, tripled, name):
    """All ends of all edges were joined, and sorted in the few tasks that their small files were merged into."""
    compare(spark, tripled, name)
    plan = registry.QUERIES[name](spark, str(tripled))._jdf.queryExecution().optimizedPlan().toString()
    side = plan[plan.index("Join LeftSemi" if name == "join_semi" else "Join LeftAnti") :]
    assert "Aggregate [node#" in side


@pytest.mark.parametrize("name", ["text_trigram_search", "text_token_search", "text_hybrid_search"])
def test_a_search_makes_no_index(spark, tripled, name):
    from kumihimo.plans.text_index import _tables
    from kumihimo.sources.graph import Graph
    from kumihimo.sources.stored import kept

    compare(spark, tripled, name)
    assert not any(kept(spark, f"index-{kind}", _tables(Graph(spark, str(tripled)))) for kind in ("grams", "words"))


def test_scan_and_index_rank_alike(spark, tripled):
    from kumihimo.plans.text_index import index_of, ranked, scanned, tokens_of
    from kumihimo.sources.graph import Graph

    odd = spark.createDataFrame([(1, "aaaa", "AAA"), (2, "a a a b", None), (3, None, None), (4, "", "á a")], "id long, label string, label_en string")
    rows = lambda phrase, kind: {x["id"]: (x["tf"], x["length"]) for x in scanned(odd, phrase, tokens_of(spark, phrase, kind), kind).collect()}
    assert rows("aaa", "grams") == {1: (3, 3), 2: (0, 5), 3: (0, 0), 4: (0, 1)}
    assert rows("a a", "words") == {1: (0, 2), 2: (2, 4), 3: (0, 0), 4: (1, 2)}
    g = Graph(spark, str(tripled))
    before = {(w, k): ranked(g, w, k, 40).collect() for w, k in (("able", "grams"), ("of the", "words"))}
    for (w, k), rows_ in before.items():
        assert rows_ and rows_ == index_of(g, k).ranked(tokens_of(spark, w, k), 40).collect()


@pytest.mark.parametrize("name", ["gen_region_cross_theme", "gen_person_place_geo"])
def test_few_pairs_go_to_the_edges(spark, tripled, name):
    compare(spark, tripled, name)
    assert "LeftSemi" in registry.QUERIES[name](spark, str(tripled))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_export_cross", "q_export_pilgrimage"])
def test_exports_join_the_first_rows(spark, tripled, name):
    compare(spark, tripled, name)
    assert "Join" not in registry.QUERIES[name](spark, str(tripled))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("gone", [3, 200])
def test_first_rows_are_whole_where_a_join_takes_many(spark, gone):
    from kumihimo.plans.analytics import _first_joined

    class G:
        pass

    G.spark = spark
    got = _first_joined(G, spark.range(400), ["id"], lambda rows: rows.where(f"id >= {gone}"), 10).collect()
    assert [x["id"] for x in got] == list(range(gone, gone + 10))


def test_texts_of_one_row_group_are_cut_by_many_tasks(spark, tripled, tmp_path, monkeypatch):
    """All texts of a file of one row group were cut in the task that read it; and postings were shuffled into buckets."""
    from kumihimo.plans import text_index
    from kumihimo.sources.graph import Graph

    labels = Graph(spark, str(tripled)).entities.select("id", "label", "label_en").coalesce(1)
    monkeypatch.setattr(text_index, "TASK_CHARACTERS", labels.selectExpr("sum(length(label) + ifnull(length(label_en), 0))").first()[0] // 5 + 1)
    text_index.write_index(labels, "grams", str(tmp_path / "ix"), buckets=2)
    index = text_index.Index(spark, str(tmp_path / "ix"), "grams", 2)
    makers = {f.rsplit("/part-", 1)[1][:5] for f in index.all.inputFiles()}
    assert len(makers) == 5
    monkeypatch.undo()
    assert [text_index.tasks_for(n * 1_000_000, 12) for n in (0, 1, 40, 6000)] == [1, 2, 12, 500]
    compare(spark, tripled, "text_trigram_index")


def test_trigrams_of_odd_texts_in_slices(spark, monkeypatch):
    """Runs made by slices of rows, as by hand: short, empty and null texts, letters beyond 16 bits, one text above a slice."""
    from kumihimo.plans import text_index

    monkeypatch.setattr(text_index, "SLICE", 7)
    rows = [(1, "aaaa", "AAA"), (2, "", None), (3, None, "ab"), (4, "𠮷野家𠮷野家", "x"), (None, "Abc abc ABC", None), (4, "𠮷野家", None), (5, "\u0000\u0001z", "é́è")]
    got = []
    spread = spark.createDataFrame(rows, "id long, label string, label_en string").coalesce(1)
    batch = spread.selectExpr("id", "0L length", "stack(2, 'label', lower(label), 'label_en', lower(label_en)) as (field, text)").where("length(text) >= 3").toArrow()
    for out in text_index._gram_runs(iter(batch.to_batches())):
        got += [(x["token"], x["id"], x["field"], tuple(x["positions"])) for x in out.to_pylist()]
    want = []
    for id_, *labels in rows:
        for field, text in zip(("label", "label_en"), labels, strict=True):
            t = (text or "").lower()
            runs = {}
            for i in range(len(t) - 2):
                runs.setdefault(t[i : i + 3], []).append(i)
            want += [(k, id_, field, tuple(v)) for k, v in runs.items()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = sorted(((x["token"], x["id"], x["field"], tuple(x["positions"])) for x in text_index.postings(spread, "grams").collect()), key=repr)
    assert whole == sorted(want, key=repr)


def test_edges_are_dealt_before_they_are_sorted(spark, tmp_path):
    """Wide rows were sorted in the tasks that read whole splits, and again after the shuffle in as many tasks as the session has. First rows with ties, against SQL."""
    from kumihimo.sources.graph import Graph, edge_tasks

    line = f"SELECT * FROM '{FOLDER}/lineitem.parquet'"
    tied = f"{line} UNION ALL SELECT * REPLACE (l_discount + 0.01 AS l_discount, 'R' AS l_returnflag, l_tax / 2 AS l_tax) FROM ({line}) UNION ALL SELECT * REPLACE ('R' AS l_returnflag, 'O' AS l_linestatus) FROM ({line})"
    duckdb.sql(f"COPY ({tied}) TO '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/orders.parquet' UNION ALL SELECT * REPLACE ('F' AS o_orderstatus) FROM '{FOLDER}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t in ('lineitem', 'orders') else FOLDER}/{t}.parquet'")
    want = con.sql(registry.with_views("SELECT * FROM connections")).fetchall()
    made = Graph(spark, str(tmp_path)).made_edges()
    assert sorted(tuple(x) for x in made.collect()) == sorted(want) and len({x[2:3] + x[4:] for x in want}) >= 5
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan[plan.index("REPARTITION_BY_NUM") :]
    assert [edge_tasks(n, 12) for n in (0, 150_000, 10_000_000, 432_000_000)] == [1, 2, 12, 173]


@pytest.mark.parametrize("name", ["agg_ratio_density", "agg_score_dims", "proj_other_endpoint"])
def test_edges_of_copies(spark, tripled, name):
    compare(spark, tripled, name)


@pytest.mark.parametrize("name", ["q_region_profile", "q_prefecture_profile"])
def test_profiles_pass_over_the_edges_once(spark, tripled, name):
    """Edges were counted three times, and points joined with each count; now all counts come from one pass."""
    compare(spark, tripled, name)
    plan = registry.QUERIES[name](spark, str(tripled))._jdf.queryExecution().optimizedPlan().toString()
    assert "a_id" not in plan and "verdict" not in plan


def test_stream_postings_share_a_row_and_come_back_whole(spark, tmp_path):
    """Labels of two batches, and characters too many for short codes: as many rows as trigrams for each task, the postings of direct computation."""
    import random

    from kumihimo.streaming import index as streamed

    r, index = random.Random(5), str(tmp_path / "ix")
    wide = "".join(map(chr, range(0x4E00, 0x9FF0))) + "\U0001f600\U0010ffff"
    labels = ["".join(r.choice("abc") for _ in range(r.randrange(1, 60))) for _ in range(400)] + [wide, "aaaa" + wide[:7], "\U0001f600\U0001f600\U0001f600\U0001f600"]
    for n, part in enumerate((range(0, 200), range(200, len(labels)))):
        streamed.add_batch(spark, spark.createDataFrame([(i, labels[i], None, None) for i in part], "id long, label string, lat double, lon double").coalesce(1), index, n, buckets=4)
    want = {}
    for i, text in enumerate(labels):
        for at in range(len(text) - 2):
            want.setdefault((text[at : at + 3], i, "label", len(text) - 2), []).append(at)
    got = [((p["token"], p["id"], p["field"], p["length"]), p["positions"]) for p in streamed.read_index(spark, index, "postings").collect()]
    assert len(got) == len(want) and dict(got) == want
    tokens = {k[0] for k in want}
    assert spark.read.parquet(f"{index}/postings").count() <= 2 * 27 + len(tokens) < len(want)
    assert {x["token"]: x["n"] for x in streamed.labels_of_tokens(spark, index).collect()} == Counter(k[0] for k in want)
    assert sorted((p["id"], p["positions"]) for p in streamed.with_token(spark, index, "abc", 4).collect()) == sorted((k[1], v) for k, v in want.items() if k[0] == "abc")


def test_ingest_keeps_no_texts_as_state(spark, tmp_path):
    """Long labels of digits, which do not compress to little: state is their digests; repeats, also of a later file, are dropped all the same."""
    import json
    import random

    from kumihimo.streaming import ingest

    r, inbox, marks, store = random.Random(3), tmp_path / "in", tmp_path / "marks", str(tmp_path / "store")
    inbox.mkdir()
    texts = ["".join(r.choice("0123456789abcdef") for _ in range(50_000)) for _ in range(20)]
    line = lambda i, text: json.dumps({"id": i, "label": text, "source": "s", "seen": "2024-01-01T00:00:00"})
    for n, rows in enumerate((texts + [t.upper() for t in texts], [" " + texts[0], "new"])):
        (inbox / f"{n}.json").write_text("\n".join(line(i, t) for i, t in enumerate(rows)))
        ingest.ingest_new_labels(spark, str(inbox), store, str(marks)).awaitTermination()
    assert sorted(x["key"] for x in spark.read.parquet(store).collect()) == sorted([*texts, "new"])
    assert sum(f.stat().st_size for f in (marks / "state").rglob("*") if f.is_file()) < 100_000


def test_tasks_share_a_file_of_the_store(spark, tmp_path, monkeypatch):
    """A file of long labels was one row group, which one task read and cut."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from kumihimo.streaming import ingest

    monkeypatch.setattr(ingest, "ROW_GROUP", 200_000)
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    label = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)))
    spark.range(2000).select("id", label.alias("label"), F.lit("s").alias("source"), F.lit("2024-01-01T00:00:00").alias("seen")).write.json(inbox)
    ingest.ingest_new_labels(spark, inbox, store, str(tmp_path / "marks")).awaitTermination()
    files = [pq.ParquetFile(f) for f in (tmp_path / "store").glob("*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 2000
    assert all(f.num_row_groups > 1 for f in files if f.metadata.num_rows), [(f.metadata.num_rows, f.num_row_groups) for f in files]


def test_radius_join_compares_places(spark, tmp_path):
    """Every entity was joined with all those of nine cells; now blocks of places are joined, and pairs made from them."""
    for t in TABLES:
        key = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}.get(t)
        rows = f"SELECT t.* REPLACE ({key} + 100000 * i AS {key}) FROM '{FOLDER}/{t}.parquet' t, range(60) r(i)" if key else f"SELECT * FROM '{FOLDER}/{t}.parquet'"
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
    compare(spark, tmp_path, "join_grid_radius")
    df = registry.QUERIES["join_grid_radius"](spark, str(tmp_path))
    assert largest_join(df) < df.count() / 5


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_pairs_of_places_are_whole(spark, monkeypatch, block):
    """Blocks of several sizes, kinds that are null, places on one another, repeated rows: against direct computation."""
    import random

    from kumihimo.plans import joins

    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    r = random.Random(block)
    rows = [(i, r.choice([35.0, 35.004, 35.02]), r.choice([135.0, 135.003]), r.choice(["k", "m", None])) for i in range(70)] + [(3, 35.0, 135.0, "k")] * 2
    placed = spark.createDataFrame(rows, "id long, lat double, lon double, kind string")
    out = joins.place_pairs(placed, joins.place_distances(placed, 600.0), block)
    got = sorted((x["a_id"], x["b_id"], round(x["metres"])) for x in out.collect())
    from math import asin, cos, radians, sin, sqrt

    def metres(x, y):
        h = sin(radians(y[1] - x[1]) / 2) ** 2 + cos(radians(x[1])) * cos(radians(y[1])) * sin(radians(y[2] - x[2]) / 2) ** 2
        return 2 * 6371000.0 * asin(sqrt(h))

    want = [(x[0], y[0], round(metres(x, y))) for x in rows for y in rows if x[0] < y[0] and metres(x, y) <= 600 and not (x[3] and x[3] == y[3])]
    assert got == sorted(want) and len({m for *_, m in want}) > 2


def test_degree_pairs_up_to_the_whole_threshold(spark, tripled):
    """Pairs from a hundredth to a tenth of a degree apart were left out; all that have no edge are there."""
    from kumihimo.sources.graph import Graph

    g = Graph(spark, str(tripled))
    points = [tuple(x) for x in g.entities.where("lat is not null").select("id", "lat", "lon").collect()]
    edges = {(x["a_id"], x["b_id"]) for x in g.edges.select("a_id", "b_id").collect()}
    far = {(a, b): ((p - q) ** 2 + (u - v) ** 2) ** 0.5 for a, p, u in points for b, q, v in points if a < b}
    want = {k for k, d in far.items() if d < 0.1} - edges
    got = [(x["x"], x["y"]) for x in registry.QUERIES["gen_proximity_deg"](spark, str(tripled)).toDF("x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(far[k] > 0.01 for k in want) > 1000


def test_containment_shuffles_no_text(spark, tmp_path):
    """Whole texts with a candidate were joined by id, so they were shuffled and sorted; now what is shuffled is short texts found."""
    from pyspark.sql import functions as F

    from kumihimo.plans.joins import contained

    spark.range(300).select("id", F.concat_ws(" ", F.lit("old gear"), F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256))).alias("long")).write.parquet(str(tmp_path / "long"))
    short = spark.createDataFrame([(1, "old gear"), (2, "old gears")], "key long, short string")
    df = contained(short, spark.read.parquet(str(tmp_path / "long")))
    assert sorted(tuple(x) for x in df.collect()) == [(1, i) for i in range(300)]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning" in plan and not any("Exchange" in x and "long#" in x for x in plan.splitlines())
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("long#" in x for x in joins) and "MapInArrow" in plan


def test_containment_of_odd_texts(spark, monkeypatch):
    """Runs at borders of rows and slices, letters of several bytes, names inside names, against direct computation."""
    import random

    from kumihimo.plans import joins

    monkeypatch.setattr(joins, "LOOKED_AT", 11)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("ab é日𠮷") for _ in range(n))
    longs = [word(r.randrange(0, 40)) for _ in range(150)] + ["", "ab", None, "日" * 30, "aaaaaa", "日本", "é日𠮷"]
    shorts = sorted({*(word(r.randrange(1, 6)) for _ in range(120)), "aaa", "日日日", "日日日日", "ab", "", longs[3], "nowhere"})
    rows = [(i, s) for i, s in enumerate(shorts)] + [(-1, "aaa"), (-2, None)]
    got = joins.contained(spark.createDataFrame(rows, "key long, short string"), spark.createDataFrame(list(enumerate(longs)), "id long, long string").coalesce(2)).collect()
    want = [(k, i) for k, s in rows for i, t in enumerate(longs) if s is not None and t is not None and len(s) >= 3 and s in t]
    assert sorted(tuple(x) for x in got) == sorted(want) and len(want) > 100


def test_stream_postings_stay_in_the_task_that_cut_them(spark, tmp_path):
    """Postings, several times the texts, were all shuffled into buckets; now each task writes its own, until a bucket is written whole."""
    from kumihimo.streaming import index as streamed

    index = str(tmp_path / "ix")
    texts = [(i, f"{i} some label of number {i * 7919}", None, None) for i in range(300)]
    for n in range(2):
        batch = spark.createDataFrame(texts[n::2], "id long, label string, lat double, lon double").repartition(3)
        streamed.add_batch(spark, batch, index, n, buckets=2, most=1)
        makers = {f.name[:10] for f in (tmp_path / "ix" / "postings" / f"v={n}").rglob("part-*.parquet")}
        assert len(makers) == (3 if n == 0 else 0)
        live = streamed.manifest(spark, index)
        assert {v for (k, _), vs in live.items() if k == "postings" for v in vs} == {"0" if n == 0 else "1c"}
    assert all(len(list(b.glob("part-*.parquet"))) == 1 for b in (tmp_path / "ix" / "postings" / "v=1c").iterdir() if b.is_dir())
    got = Counter(x["token"] for x in streamed.read_index(spark, index, "postings").collect())
    assert got == Counter(t for _, s, *_ in texts for t in {s[i : i + 3] for i in range(len(s) - 2)})


def test_stream_query_removes_what_it_landed(spark, tripled):
    """The arriving files and the store were left beside the index, whole texts in each."""
    from pathlib import Path

    from kumihimo.sources.stored import shared_folder

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    compare(spark, tripled, "stream_index_refresh")
    left = {p for d in set(shared.iterdir()) - before for p in d.rglob("*") if p.is_file() and "postings" not in p.parts and "grid" not in p.parts}
    assert not any("able" in p.read_text(errors="ignore") for p in left if p.suffix == ".json" and "manifest" not in p.parts)
    assert not any(p.suffix == ".parquet" for p in left)
