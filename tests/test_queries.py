"""Queries against their DuckDB oracles on the smallest tables."""

import math

import duckdb
import pytest

from kumihimo.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()
#: One of each kind; the whole list is compared by the same code outside the test run.
CHOSEN = [
    "scan_edges", "filt_bbox", "filt_exclude_ids", "filt_only_value", "sort_then_resort", "sample_hash_pct", "set_tag_diff", "set_pair_dedupe",
    "join_edge_either_end", "join_left_count", "join_grid_radius", "join_fallback_chain", "join_fuzzy", "agg_tag_map", "agg_entropy", "agg_latency_stats", "agg_coverage_matrix",
    "win_nearest_k", "win_new_and_cumulative", "win_group_quota", "fn_tile_xy", "fn_regnal_year", "fn_kanji_number", "fn_granularity", "fn_theme_distance", "fn_score_rule_v2", "fn_text_overlap",
    "text_trigram_search", "text_token_search", "text_hybrid_search", "text_bm25", "text_title_containment", "src_geojson_points", "src_claim_value", "src_external_ids", "sink_dataset", "sink_geojson", "stream_index_refresh", "job_geo_from_tag", "job_geo_from_label", "job_filter_granularity", "job_audit_prefix", "job_tag_persons", "job_retag_specific", "win_grid_layout", "gen_same_theme_sample", "text_theme_fallback", "gen_theme_scored_v2", "gen_isolated_nearest", "gen_cross_medium_zip", "gen_pilgrimage_landmark",
    "job_dedupe_name_radius", "job_dedupe_work_author", "job_autotag", "job_heritage_rank", "job_verdict_merge", "job_release_year_tiers", "job_dormant", "job_graph_health", "q_region_profile", "q_bulk_profiles", "q_explore", "q_serendipity_walk", "q_deep_dive", "q_emergence", "q_prefecture_profile", "q_tourism_assets", "q_compare", "q_timeline", "q_map_work",
]


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    relation = duck.sql(registry.ORACLES[name])
    columns = list(relation.columns)
    assert sorted(columns) == names
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(r[columns.index(n)]) for n in names) for r in relation.fetchall()), key=repr)
    assert got == want


def test_all_but_stateful_queries_have_oracles():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"q_pilgrimage_route"}


def test_route_visits_each_place_once(spark):
    rows = registry.QUERIES["q_pilgrimage_route"](spark, FOLDER).collect()
    works = {}
    for r in rows:
        works.setdefault(r["work"], []).append((r["pos"], r["place"]))
    assert works
    for stops in works.values():
        assert sorted(p for p, _ in stops) == list(range(len(stops)))
        assert len({x for _, x in stops}) == len(stops) <= 20


def test_no_cross_product_in_plans(spark):
    for name in ("join_edge_either_end", "q_region_profile", "win_nearest_k", "join_containment_prune"):
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
