"""Distances between tag sets, as column expressions over sorted arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ERAS


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - shared / all; 0.5 if a side is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.5)).otherwise(1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def era_distance(a: Column, b: Column) -> Column:
    """Steps between the earliest eras, of eight; an unknown era is in the middle."""
    index = F.create_map(*[x for i, e in enumerate(ERAS) for x in (F.lit(e[0]), F.lit(i))])
    first = lambda side: F.array_min(F.transform(side, lambda e: F.coalesce(F.try_element_at(index, e), F.lit(4))))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.5)).otherwise(F.abs(first(a) - first(b)) / 8.0)


def closure(parents: DataFrame, levels: int = 4) -> DataFrame:
    """(code, ancestor, up) of a dictionary of (code, parent): each code is its own ancestor 0 steps up; cycles end."""
    at = parents.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("up"))
    out = at
    step = parents.where("parent is not null").select(F.col("code").alias("ancestor"), "parent")
    for n in range(1, levels + 1):
        at = at.join(F.broadcast(step), "ancestor").where("parent <> code").select("code", F.col("parent").alias("ancestor"), F.lit(n).alias("up"))
        out = out.unionByName(at)
    return out.groupBy("code", "ancestor").agg(F.min("up").alias("up"))


def tree_distance(parents: DataFrame) -> DataFrame:
    """(a, b, steps): tree path length of all related codes of a dictionary (at most some hundred codes)."""
    up = closure(parents)
    a, b = up.select(F.col("code").alias("a"), "ancestor", F.col("up").alias("ua")), up.select(F.col("code").alias("b"), "ancestor", F.col("up").alias("ub"))
    return a.join(b, "ancestor").groupBy("a", "b").agg(F.min(F.col("ua") + F.col("ub")).alias("steps"))


def theme_distance(steps: Column, empty: Column) -> Column:
    """From the least path length of two code sets (null: unrelated): 0.2 a step, at most 0.6; 0.8 unrelated; 0.5 if a side is empty."""
    return F.when(empty, F.lit(0.5)).when(steps.isNull(), 0.8).otherwise(F.least(F.lit(0.6), steps * 0.2))


def medium_distance(kin: Column, empty: Column) -> Column:
    """kin: 0 equal, 1 parent and child, 2 siblings, null unrelated. The nearest kinship counts."""
    return F.when(empty, F.lit(0.5)).when(kin == 0, 0.0).when(kin == 1, 0.15).when(kin == 2, 0.3).otherwise(1.0)
