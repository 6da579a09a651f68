"""Rule tables that score a pair by its distances: first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(score, quality: str, rule) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(score).cast("double").alias("score"), F.lit(quality).alias("quality"), lit(rule).alias("rule"))


# Rules in order of trial; the first that fits counts. A rule has bands of distances (above, below; None: open),
# whether the two types must differ (None: no matter), a factor, what it is multiplied with in turn, quality and name.
# near: 1 - theme; bonus: a tenth more between different types. The third rule of the first table can't fire, as the first covers it.
RULES_V1 = [
    ({"theme": (None, 0.3), "era": (0.3, None)}, None, 1.2, ("near", "era"), "good_surprise", "era_bridge"),
    ({"theme": (None, 0.3), "medium": (0.5, None)}, None, 1.1, ("near", "medium"), "good_surprise", "medium_cross"),
    ({"theme": (None, 0.3), "era": (0.5, None), "medium": (0.5, None)}, None, 1.0, ("near", "era", "medium"), "good_surprise", "good_surprise_classic"),
    ({"theme": (None, 0.3), "geo": (0.5, None)}, None, 1.0, ("near", "geo"), "good_surprise", "geo_theme"),
    ({"theme": (None, 0.2), "era": (None, 0.2), "medium": (None, 0.2)}, None, 0.2, (), "obvious", "obvious"),
    ({"theme": (0.7, None), "era": (0.7, None), "medium": (0.7, None)}, None, 0.05, (), "bad_surprise", "random"),
    ({}, None, 0.3, (), "moderate", "default"),
]
RULES_V2 = [
    ({"theme": (None, 0.5), "era": (0.3, None)}, None, 1.2, ("near", "era", "bonus"), "good_surprise", "era_bridge"),
    ({"theme": (None, 0.5), "medium": (0.5, None)}, None, 1.1, ("near", "medium", "bonus"), "good_surprise", "medium_cross"),
    ({"theme": (None, 0.5), "geo": (0.3, 1.0)}, None, 1.0, ("near", "geo", "bonus"), "good_surprise", "geo_theme"),
    ({"theme": (None, 0.5), "experience": (0.5, None)}, None, 0.9, ("near", "experience"), "good_surprise", "experience_shift"),
    ({"theme": (None, 0.5)}, True, 0.8, ("near",), "moderate", "cross_type"),
    ({"theme": (None, 0.2), "era": (None, 0.2), "medium": (None, 0.2)}, None, 0.15, (), "obvious", "obvious"),
    ({"theme": (0.7, None), "era": (0.7, None), "medium": (0.7, None)}, None, 0.05, (), "bad_surprise", "random"),
    ({"theme": (None, 0.5)}, None, 0.3, ("near",), "moderate", "default"),
    ({}, None, 0.1, (), "weak", "default"),
]


def score_by(rules: list, distances: dict[str, Column], a_type: Column | None = None, b_type: Column | None = None) -> Column:
    """Score, quality and rule of a pair, by a table of rules over its distances."""
    differ = F.lit(False) if a_type is None else a_type != b_type
    terms = {**distances, "near": 1 - distances["theme"], "bonus": F.when(differ, 1.1).otherwise(1.0)}
    out = None
    for bands, apart, factor, product, quality, name in rules:
        fits = F.lit(True)
        for what, (above, below) in bands.items():
            fits = fits if above is None else fits & (distances[what] > above)
            fits = fits if below is None else fits & (distances[what] < below)
        if apart:
            fits, name = fits & differ, F.concat_ws("_", F.lit(name), F.least(a_type, b_type), F.greatest(a_type, b_type))
        score = F.lit(factor)
        for t in product:
            score = score * terms[t]
        row = _row(score, quality, name)
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def score_rule_v1(theme: Column, era: Column, medium: Column, geo: Column) -> Column:
    return score_by(RULES_V1, {"theme": theme, "era": era, "medium": medium, "geo": geo})


def score_rule_v2(theme: Column, era: Column, medium: Column, geo: Column, experience: Column, a_type: Column, b_type: Column) -> Column:
    return score_by(RULES_V2, {"theme": theme, "era": era, "medium": medium, "geo": geo, "experience": experience}, a_type, b_type)


#: Rules that users add: name -> Column of an entity or edge frame.
EXTRA: dict[str, Column] = {}


def register_rule(name: str, condition: Column) -> None:
    """Add a condition of one's own to those that ``flagged`` and the blocklist apply."""
    EXTRA[name] = condition


def flagged(df: DataFrame, names=None) -> DataFrame:
    """``df`` with ``flags``: the names of the added rules (or of some of them) that hold for a row, in order of registration."""
    chosen = list(EXTRA) if names is None else list(names)
    hits = [F.when(EXTRA[n], F.lit(n)) for n in chosen]
    return df.withColumn("flags", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))
