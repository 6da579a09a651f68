"""k nearest places and links to next members against brute force, in dense cells and in large groups."""

import math
import random

from pyspark.sql import functions as F

from kumihimo.plans import nearest, windows

POINT = "id long, lat double, lon double, kind string"


def metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute(queries, points, radius, k, least=0.0, by_kind=True):
    out = set()
    for a in queries:
        groups = {}
        for b in points:
            if a[0] != b[0] and None not in (a[1], a[2], b[1], b[2]) and least <= (d := metres(a, b)) <= radius:
                groups.setdefault(b[3] if by_kind else "", []).append((math.floor(d + 0.5), b[0]))
        out |= {(a[0], b, kind, m, i + 1) for kind, xs in groups.items() for i, (m, b) in enumerate(sorted(xs)[:k])}
    return out


def cloud(seed=3):
    r = random.Random(seed)
    rows = [(i, 35 + r.random() * 0.02, 135 + r.random() * 0.02, r.choice("ab")) for i in range(150)]
    rows += [(1000 + i, 35.005 + r.gauss(0, 1e-4), 135.006 + r.gauss(0, 1e-4), "a") for i in range(200)]  # one dense cell
    rows += [(3000 + i, 35.011, 135.012, "b") for i in range(60)]  # one place
    return [*rows, (5000, None, 1.0, "a"), (5001, 36.5, 135.0, "a")]


def test_nearest_against_all_pairs(spark):
    rows = cloud()
    df = spark.createDataFrame(rows, POINT)
    some = [x for x in rows if x[0] % 7 == 0]
    asked = spark.createDataFrame(some, POINT)
    for radius, k, least, slack in ((1000.0, 3, 0.0, 12), (900.0, 2, 300.0, 2)):
        got = {tuple(x) for x in nearest.k_nearest(asked, df, radius, k, least, "kind", slack=slack).select("a_id", "b_id", "kind", "m", "rn").collect()}
        assert got == brute(some, rows, radius, k, least)
    got = {tuple(x) for x in nearest.k_nearest(asked, df, 1000.0, 3, slack=200).select("a_id", "b_id", "kind", "m", "rn").collect()}
    assert got == brute(some, rows, 1000.0, 3, by_kind=False)


def test_rows_before_the_rank_grow_with_k_and_not_with_the_cell(spark):
    """10,000 points in one cell: what meets a query is a small multiple of k, however dense they are."""
    grid = spark.range(10_000).select("id", (35.001 + F.col("id") % 100 * 7e-5).alias("lat"), (135.001 + F.floor(F.col("id") / 100) * 7e-5).alias("lon"))
    asked = grid.where("id % 97 = 0")
    k = 3
    rows, queries = nearest.candidates(asked, grid, 1000.0, k).count(), asked.count()
    assert rows <= 20 * (k + 1) * queries < 10_000 * queries / 50
    same = grid.select("id", F.lit(35.001).alias("lat"), F.lit(135.001).alias("lon"))
    assert nearest.candidates(same, same, 1000.0, k).count() == 1  # all at one place are one row
    assert nearest.k_nearest(same, same, 1000.0, k).count() == k * 10_000


def test_links_over_many_ranges(spark):
    """One group holds most rows: its links are whole over the borders of ranges, and many tasks make them."""
    r = random.Random(5)
    rows = [(i, "big" if i % 10 else f"g{i % 70}", r.randrange(50)) for i in range(3_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id long, v string, o long")
        ranges = windows.ranged(df, ["v"], ["o", "id"]).where("v = 'big'").select("pid").distinct().count()
        assert ranges >= 3
        for k in (1, 3):
            got = {tuple(x) for x in windows.linked_to_next(df, ["v"], ["o", "id"], k).select("v", "x", "y", "step").collect()}
            want = set()
            for v in {x[1] for x in rows}:
                ids = [i for i, w, o in sorted(rows, key=lambda x: (x[2], x[0])) if w == v]
                want |= {(v, ids[p], ids[p + j], j - 1) for p in range(len(ids)) for j in range(1, k + 1) if p + j < len(ids)}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_over_many_ranges(spark):
    class G:
        pass

    g = G()
    g.spark = spark
    rows = [(i, "big" if i % 10 else f"g{i % 70}") for i in range(2_000)]
    got = {(x["id"], x["v"]): (x["i"], x["n"]) for x in windows.numbered(g, spark.createDataFrame(rows, "id long, v string"), ["v"], ["id"]).collect()}
    for v in {x[1] for x in rows}:
        ids = sorted(i for i, w in rows if w == v)
        assert [got[i, v] for i in ids] == [(p, len(ids)) for p in range(len(ids))]
