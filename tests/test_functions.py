"""Japanese text, years, distances: cases with known values."""

import pytest
from pyspark.sql import functions as F

from kumihimo.functions import distance, geo, strings, years
from kumihimo.plans.search import trigram_hits


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("四十九", 49), ("元", 1), ("百", 100), ("", None), ("二十x三", 20), ("１", None)])
def test_kanji_number(spark, text, want):
    assert one(spark, years.kanji_number, text) == want


@pytest.mark.parametrize(("text", "want"), [("昭和49年", 1974), ("昭和四十九年", 1974), ("平成元年", 1989), ("大正99年", 2010), ("x", None)])
def test_regnal_year(spark, text, want):
    assert one(spark, years.regnal_year, text) == want


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (years.semicolon_year, "x;1932-05-01", 1932),
        (years.semicolon_year, "x;1932", 1932),
        (years.semicolon_year, "x;19320", None),
        (years.disambiguation_year, "題（1973年の映画）", 1973),
        (years.disambiguation_year, "題[1973]", 1973),
        (years.generic_year, "1399年", None),
        (years.generic_year, "2027年", None),
        (years.era11, "c. 1650", "edo"),
        (strings.norm_title, "ＡＢＣ　１", "ABC 1"),
        (strings.strip_disambiguation, "題（映画）", "題"),
        (strings.norm_label, "【新】題(a)（b）", "題"),
        (strings.qid, "http://x/entity/Q12", "Q12"),
        (strings.record_id, "https://x/books/R100?v=1", "R100"),
        (strings.quoted_place, "同じ場所「鎌倉市」を舞台", "鎌倉市"),
        (strings.granularity, "日本", "L1"),
        (strings.granularity, "東京都", "L3_prefecture"),
        (strings.granularity, "大阪市", "L4_high_density"),
        (strings.granularity, "鎌倉市", "L4_city"),
        (strings.granularity, "東京ドーム", "L5_venue"),
        (strings.granularity, "江ノ島", "L5_spot"),
        (strings.all_digits, "１２３４５６", True),
        (strings.low_unique, "ああああああ", True),
        (strings.low_unique, "日本の山川", False),
    ],
)
def test_text(spark, column, text, want):
    assert one(spark, column, text) == want


@pytest.mark.parametrize(("text", "want"), [("Point(135.7 35.0)", (35.0, 135.7)), ("Point(200 35)", (None, None)), ("x", (None, None))])
def test_point(spark, text, want):
    lat, lon = geo.parse_point(F.lit(text))
    row = spark.range(1).select(lat.alias("a"), lon.alias("b")).first()
    assert (row["a"], row["b"]) == want


def test_set_distances(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    got = [r[0] for r in df.select(distance.jaccard_distance(F.col("x"), F.col("y"))).collect()]
    assert got == [0.5, 0.5, pytest.approx(2 / 3)]
    eras = spark.createDataFrame([(["edo_early"], ["heisei"]), (["heian"], ["medieval"]), ([], ["x"])], "x array<string>, y array<string>")
    assert [r[0] for r in eras.select(distance.era_distance(F.col("x"), F.col("y"))).collect()] == [5 / 8, 3 / 8, 0.5]


def test_tree_distance_ends_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "code string, parent string")
    steps = {(r["a"], r["b"]): r["steps"] for r in distance.tree_distance(parents).collect()}
    assert steps[("a", "a")] == 0 and steps[("a", "b")] == 1 and steps[("a", "c")] == 2


def test_trigram_search_of_cjk(spark):
    class G:
        entities = spark.createDataFrame([(1, "金閣寺"), (2, "銀閣寺"), (3, "金閣寺前"), (4, None), (5, "")], "id long, label string")

    assert {r["id"] for r in trigram_hits(G, "金閣寺").collect()} == {1, 3}
