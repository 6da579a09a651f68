"""Exact k nearest neighbours within a radius, by cells that get finer where points are dense."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m
from ..sources.graph import first_per

c = F.col

#: A place whose cells hold more than so many times k points has them cut into finer ones.
SLACK = 12
DEPTH = 12


def _metres(h: Column) -> Column:
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _half(x: Column) -> Column:
    return F.pow(F.sin(F.radians(x) / 2), 2)


def _bounds(high: float, wide: float) -> tuple[Column, Column]:
    """Least and greatest distance of (qlat, qlon) from the points of cell (cy, cx)."""
    south, west = c("cy") * high, c("cx") * wide
    north, east = south + high, west + wide
    gap = lambda x, low, up: F.greatest(low - x, x - up, F.lit(0.0))
    far = lambda x, low, up: F.greatest(F.abs(x - low), F.abs(up - x))
    own = F.cos(F.radians("qlat"))
    edge = [F.cos(F.radians(south)), F.cos(F.radians(north))]
    widest = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(*edge))
    least = _half(gap(c("qlat"), south, north)) + own * F.least(*edge) * _half(gap(c("qlon"), west, east))
    most = _half(far(c("qlat"), south, north)) + own * widest * _half(far(c("qlon"), west, east))
    return _metres(least), _metres(most)


def k_nearest(queries: DataFrame, points: DataFrame, radius: float, k: int, least: float = 0.0, kind: str | None = None, at_lat: float = 46.0, slack: int = SLACK) -> DataFrame:
    """queries and points: id, lat, lon -> (a_id, b_id, kind, m, rn): of each kind of point the k nearest to each query, other than itself.

    m is the distance in whole metres, in order of which, and of ids, rn
    counts; distances lie between ``least`` and ``radius``. ``kind`` names a
    column of points; without it all are of one.

    Points of one place and kind are one row with their k + 1 least ids, as no
    other can be chosen, and queries of one place are asked once. A place
    first meets the 3 x 3 cells around it, as wide as the radius. Where these
    hold more than ``slack`` * k points they are cut into four, again and
    again: the farthest corners of the nearest cells that hold k points
    bound the distance of the k-th, and cells that begin beyond it are left.
    So what is compared grows with k, not with how dense the points are.
    """
    found = candidates(queries, points, radius, k, least, kind, at_lat, slack)
    near = found.withColumn("b_id", F.explode("ids")).select("qlat", "qlon", "kind", "m", "b_id")
    best = first_per(near, ["qlat", "qlon", "kind"], ["m", "b_id"]).where(c("rn") <= k + 1).drop("rn")
    asked = queries.where("lat is not null and lon is not null").select(c("id").alias("a_id"), c("lat").alias("qlat"), c("lon").alias("qlon"))
    pairs = asked.join(best, ["qlat", "qlon"]).where("a_id <> b_id").select("a_id", "b_id", "kind", "m")
    return first_per(pairs, ["a_id", "kind"], ["m", "b_id"]).where(c("rn") <= k)


def candidates(queries: DataFrame, points: DataFrame, radius: float, k: int, least: float = 0.0, kind: str | None = None, at_lat: float = 46.0, slack: int = SLACK) -> DataFrame:
    """(qlat, qlon, kind, ids, m): places that may hold one of the k + 1 nearest points."""
    # a cell is as wide as the radius where a degree of longitude is shortest, so near points lie in neighbouring cells at most
    high, wide = radius / 110_000.0, radius / (111_000.0 * math.cos(math.radians(at_lat)))
    placed = points.where("lat is not null and lon is not null").select("id", "lat", "lon", (c(kind) if kind else F.lit("")).alias("kind"))
    few = first_per(placed, ["kind", "lat", "lon"], ["id"]).where(c("rn") <= k + 1)
    places = few.groupBy("kind", "lat", "lon").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("n", F.size("ids"))
    cell = lambda level: {"cy": F.floor(c("lat") / (high / 2**level)), "cx": F.floor(c("lon") / (wide / 2**level))}
    held = lambda level: places.withColumns(cell(level)).groupBy("kind", "cy", "cx").agg(F.sum("n").alias("n"))

    asked = queries.where("lat is not null and lon is not null").select("lat", "lon").distinct().withColumns(cell(0)).select(c("lat").alias("qlat"), c("lon").alias("qlon"), "cy", "cx")
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    around = asked.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).select("qlat", "qlon", (c("cy") + c("dy")).alias("cy"), (c("cx") + c("dx")).alias("cx"))
    mine = Window.partitionBy("qlat", "qlon", "kind")

    def cut(cells: DataFrame, level: int) -> DataFrame:
        """Cells that can hold one of the k nearest, and how many points all of a query's cells hold."""
        near, far = _bounds(high / 2**level, wide / 2**level)
        sized = cells.withColumns({"near": near, "far": far}).where((c("near") <= radius + 1) & (c("far") >= least - 1))
        sure = F.when(c("near") >= least + 1, c("n")).otherwise(0)
        upto = F.sum(sure).over(mine.orderBy("far", "cy", "cx").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(c("upto") >= k + 1, c("far"))).over(mine)
        # two metres for distances that are equal only once they are rounded
        kept = sized.withColumn("upto", upto).withColumn("bound", F.coalesce(bound, F.lit(radius))).where(c("near") <= c("bound") + 2)
        return kept.withColumn("total", F.sum("n").over(mine)).select("qlat", "qlon", "kind", "cy", "cx", "n", "total")

    def levels() -> int:
        """As many as the fullest cell needs if its points lie evenly; 0 where none is full."""
        most = held(0).agg(F.max("n")).first()[0] or 0
        return 0 if 9 * most <= slack * (k + 1) else min(DEPTH, math.ceil(math.log(9 * most / (slack * (k + 1)), 4)) + 2)

    depth = levels()
    done, open_ = [], around.join(held(0), ["cy", "cx"]).select("qlat", "qlon", "kind", "cy", "cx", "n")
    if depth:
        open_ = cut(open_, 0)
    for level in range(depth):
        full = c("total") > slack * (k + 1)
        done.append((level, open_.where(~full)))
        quarter = F.array(F.lit(0), F.lit(1))
        parts = open_.where(full).withColumn("dy", F.explode(quarter)).withColumn("dx", F.explode(quarter))
        finer = parts.select("qlat", "qlon", "kind", (c("cy") * 2 + c("dy")).alias("cy"), (c("cx") * 2 + c("dx")).alias("cx"))
        open_ = cut(finer.join(held(level + 1), ["kind", "cy", "cx"]), level + 1)
    done.append((depth, open_))
    out = None
    for level, cells in done:
        at = places.withColumns(cell(level)).select("kind", "cy", "cx", "lat", "lon", "ids")
        pairs = cells.select("qlat", "qlon", "kind", "cy", "cx").join(at, ["kind", "cy", "cx"])
        out = pairs if out is None else out.unionByName(pairs)
    away = out.withColumn("metres", haversine_m(c("qlat"), c("qlon"), c("lat"), c("lon"))).where(c("metres").between(least, radius))
    return away.select("qlat", "qlon", "kind", "ids", F.floor(c("metres") + 0.5).alias("m"))


def other_kind_first(found: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """k_nearest by kind, with own (id, kind) of the queries -> (a_id, b_id, rn): the k nearest, those of another kind first."""
    mine = found.drop("rn").join(own.select(c("id").alias("a_id"), c(own.columns[1]).alias("own")), "a_id")
    return first_per(mine, ["a_id"], [(c("kind") == c("own")).cast("int"), "m", "b_id"]).where(c("rn") <= k)
