"""The stored text index and its stream: ranks, buckets, folding, batches that run again, files that stay few."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kumihimo.plans import registry, search, text_index
from kumihimo.sources import stored
from kumihimo.sources.graph import Graph
from kumihimo.streaming import index as streamed

FOLDER = "/root/testdata/sf0.001"
LABELS = [(1, "金閣寺", "Kinkaku-ji"), (2, "銀閣寺", "Ginkaku-ji"), (3, "金閣寺前", None), (4, None, None), (5, "", "Café au lait"), (6, "cafe", "CAFÉ café x"), (7, "au café lait", None), (8, "aaaa", "aaa"), (9, "ab", "日本 語")]


def built(spark, tmp_path, kind, rows=LABELS):
    path = str(tmp_path / kind)
    text_index.write_index(spark.createDataFrame(rows, "id long, label string, label_en string"), kind, path, buckets=4)
    return text_index.Index(spark, path, kind, 4)


def hits(index, text, n=20):
    return [r["id"] for r in index.ranked(text_index.tokens_of(index.spark, text, index.kind), n).orderBy("rank").collect()]


def test_grams_over_both_labels(spark, tmp_path):
    index = built(spark, tmp_path, "grams")
    assert set(hits(index, "金閣寺")) == {1, 3} and set(hits(index, "KAKU")) == {2} | {1} and hits(index, "xyz") == []
    tf = {r["id"]: r["tf"] for r in index.phrase(["aaa", "aaa"]).collect()}
    assert tf == {8: 1}  # once in aaaa, where the second run starts one later
    assert index.totals == (9, sum(max(0, len(x or "") - 2) for _, a, b in LABELS for x in (a, b)))


def test_words_without_marks_and_as_phrases(spark, tmp_path):
    index = built(spark, tmp_path, "words")
    assert set(hits(index, "cafe")) == {5, 6, 7} == set(hits(index, "CAFÉ"))
    assert hits(index, "café au") == [5] and hits(index, "au cafe") == [7]
    assert hits(index, "日本") == [9] and hits(index, "閣寺") == []  # a run in one script is one word


def test_rank_is_bm25_of_the_phrase(spark, tmp_path):
    rows = [(i, "of the " * (i % 4) + "x " * i, None) for i in range(1, 30)]
    index = built(spark, tmp_path, "words", rows)
    sizes = {i: 2 * (i % 4) + i for i, _, _ in rows}
    mean, found = sum(sizes.values()) / len(rows), [i for i in sizes if i % 4]
    idf = max(1e-6, math.log((len(rows) - len(found) + 0.5) / (len(found) + 0.5)))
    score = {i: math.floor(1e4 * idf * (i % 4) * 2.2 / ((i % 4) + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) + 0.5) for i in found}
    got = index.ranked(["of", "the"], 10).orderBy("rank").collect()
    assert [(r["id"], r["score4"]) for r in got] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_a_search_reads_its_buckets_alone(spark):
    g = Graph(spark, FOLDER)
    df = search.ranked_hits(g, "able")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:80]
    index = text_index.index_of(g, "grams")
    read = {os.path.dirname(f).rsplit("=", 1)[1] for f in index.of(["abl", "ble"]).inputFiles()}
    everything = {os.path.dirname(f).rsplit("=", 1)[1] for f in index.all.inputFiles()}
    assert len(everything) > 8 and read <= everything
    assert index.path == text_index.index_of(Graph(spark, FOLDER), "grams").path  # built once


def test_router(spark):
    g = Graph(spark, FOLDER)
    assert [r["rank"] for r in search.ranked_hits(g, "the", n=5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    short = search.ranked_hits(g, "de", n=5)
    assert {r["id"] for r in short.collect()} <= {r["id"] for r in g.entities.where(F.lower("label").rlike(r"(?<![\p{L}\p{N}])de(?![\p{L}\p{N}])")).collect()}
    assert [r["id"] for r in search.ranked_hits(g, "#0", n=3, trigrams=False, tokens=False).orderBy("rank").collect()] == [r["id"] for r in g.entities.where(F.contains("label", F.lit("#0"))).orderBy("id").limit(3).collect()]


# ---- stream


RECORD = "id long, label string, lat double, lon double"


def test_batches_leave_few_files_and_change_nothing_when_run_again(spark, tmp_path):
    index, most = str(tmp_path / "ix"), 3
    rows = [(i, f"label number {i * 7919 % 100}", 34 + i * 0.01, 135 + i * 0.01) for i in range(60)]
    for n in range(12):
        streamed.add_batch(spark, spark.createDataFrame(rows[5 * n : 5 * n + 5], RECORD), index, n, buckets=4, most=most)
        if n in (4, 9):  # a batch that fails after its work is run again
            streamed.add_batch(spark, spark.createDataFrame(rows[5 * n : 5 * n + 5], RECORD), index, n, buckets=4, most=most)
    live = streamed.manifest(spark, index)
    assert max(map(len, live.values())) <= most and {b for _, b in live} == {0, 1, 2, 3}
    grams = Counter(label[k : k + 3] for _, label, _, _ in rows for k in range(len(label) - 2))
    got = streamed.read_index(spark, index, "postings").groupBy("token").agg(F.sum(F.size("positions")).alias("n")).collect()
    assert {r["token"]: r["n"] for r in got} == grams
    assert sorted(r["id"] for r in streamed.read_index(spark, index, "grid").collect()) == list(range(60))
    # what no manifest names is gone
    files = [f for d, _, names in os.walk(f"{index}/postings") for f in names if f.endswith(".parquet")]
    assert len(files) <= 4 * (most + 2) * 2
    assert len(streamed._manifests(spark, index)) <= 3


def test_box_reads_its_cells_alone(spark, tmp_path):
    index = str(tmp_path / "ix")
    rows = [(i, f"n{i}", -2 + i * 0.05, 100 + i * 0.03) for i in range(200)]
    streamed.add_batch(spark, spark.createDataFrame(rows, RECORD), index, 0, buckets=32)
    found = streamed.in_box(spark, index, 1.0, 101.7, 1.2, 102.1, 32)
    want = [i for i, _, y, x in rows if 1.0 <= y <= 1.2 and 101.7 <= x <= 102.1]
    assert sorted(r["id"] for r in found.collect()) == want and want
    assert len(found.inputFiles()) < len(streamed.read_index(spark, index, "grid").inputFiles())
    assert streamed.in_box(spark, index, 50.0, 0.0, 51.0, 1.0, 32).count() == 0


def test_tokens_come_from_their_bucket(spark, tmp_path):
    index = str(tmp_path / "ix")
    assert streamed.with_token(spark, index, "abc", 4).count() == 0
    streamed.add_batch(spark, spark.createDataFrame([(1, "abcabc", None, None), (2, None, 1.0, None)], RECORD), index, 0, buckets=4)
    assert [(r["id"], r["positions"]) for r in streamed.with_token(spark, index, "abc", 4).collect()] == [(1, [0, 3])]


# ---- stored tables


def test_stored_edges_follow_their_tables(spark, tmp_path):
    """A table written anew under the same name gives new edges, in the same session and after the folder was cleaned."""
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    count = lambda: registry.QUERIES["scan_edges"](spark, str(tmp_path)).count()
    before = count()
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(10).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    after = count()
    assert after <= 20 < before
    g = Graph(spark, str(tmp_path))
    paths = g.edges.inputFiles()
    stored.remove(spark, os.path.dirname(paths[0]))
    assert count() == after


@pytest.mark.parametrize("words", [("asia", "nothing"), ("china",)])
def test_themes_by_children_else_siblings(spark, words):
    entities = spark.createDataFrame([(1, "a label")], "id long, label string")
    dictionary = spark.createDataFrame([("ASIA", None), ("CHINA", "ASIA"), ("JAPAN", "ASIA"), ("EUROPE", None)], "code string, parent string")
    own = spark.createDataFrame([(10, "ASIA"), (11, "CHINA"), (12, "JAPAN"), (13, "EUROPE")], "entity_id long, code string")
    got = {(r["word"], r["way"], r["entity_id"]) for r in search.label_or_theme(entities, dictionary, own, words, 5).collect()}
    if words[0] == "asia":
        assert got == {("asia", "theme", 10), ("asia", "child", 11), ("asia", "child", 12)}
    else:
        assert got == {("china", "theme", 11), ("china", "sibling", 12)}
