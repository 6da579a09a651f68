"""The pipeline on the smallest tables: each stage's decisions against brute force."""

import pyarrow.parquet as pq
import pytest

from tests.llm.test_operators import brute_hits, brute_links

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [tuple(r.values()) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect()) if name != "sentencepiece" else stage(spark, docs, FOLDER)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "jaccard_join":
            assert set(after) == {c for _, _, c in brute_links(list(before.items())).values()}
        if name == "decontaminate":
            assert set(after) == {h[0] for h in brute_hits(list(before.items()), items) if not h[5]}
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            lines = {i: set(before[i].split("\n")) for i in before}
            for i, r in after.items():
                for gone in lines[i] - set(r["text"].split("\n")):
                    assert any(gone in lines[j] for j in lines if j < i)
        if name == "sentencepiece":
            assert set(after) == set(before) and all(r["lossless"] for r in after.values())


def test_stages_on_empty_tables_nulls_and_extra_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, kept boolean"
    good = "\n".join(" ".join(f"word{k}{j}{i}" for j in range(30)) + "." for i in range(3) for k in "ab")
    rows = [(None, good, None, "s", 5, 1, None, None), (None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x", True), (1, good + "\nmore of it here.", "en", "s", 9, 1, "x", True), (1, good, "en", "s", 9, 1, "x", True)]
    for name, stage in corpus_pipeline.STAGES:
        for given in ([], rows):
            docs = spark.createDataFrame(given, kind)
            out = stage(spark, docs, FOLDER)
            assert name == "sentencepiece" or out.columns == docs.columns
            got = out.collect()
            assert len(got) <= len(given) and {r["doc_id"] for r in got} <= {None, 1}
            if given and name in ("line_dedup", "decontaminate", "sentencepiece"):
                assert any(r["doc_id"] is None for r in got)
            if given and name == "decontaminate":
                assert len(got) == len(given)
