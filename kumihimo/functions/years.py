"""Years and eras out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_MIN, YEAR_MAX = 1400, 2026

# Regnal periods and the year before their first.
REGNAL = [("明治", 1867), ("大正", 1911), ("昭和", 1925), ("平成", 1988), ("令和", 2018)]

# Upper bounds of the eleven-era list, and its last era.
ERAS11 = [(710, "ancient"), (1185, "heian"), (1333, "kamakura"), (1573, "muromachi"), (1603, "azuchi_momoyama"), (1868, "edo"), (1912, "meiji"), (1926, "taisho"), (1989, "showa"), (2019, "heisei")]
LAST_ERA = "reiwa"

_DIGITS = "〇一二三四五六七八九"


def in_range(year: Column) -> Column:
    """The year, or null outside the years that count."""
    return F.when(year.between(YEAR_MIN, YEAR_MAX), year)


def found_int(text: Column, pattern: str) -> Column:
    """First group of the first match as an int; null without a match."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def kanji_number(text: Column) -> Column:
    """四十九 -> 49; 元 is 1; other characters end the number; null if nothing counts."""
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"), F.lit(False).alias("over"))
    digit = lambda ch: F.instr(F.lit(_DIGITS), ch) - 1

    def step(s: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100)
        known = (F.length(ch) == 1) & (digit(ch) >= 0)
        return (
            F.when(s["over"], s)
            .when(unit.isNotNull(), F.struct((s["total"] + F.when(s["held"] == 0, 1).otherwise(s["held"]) * unit).alias("total"), F.lit(0).alias("held"), F.lit(False).alias("over")))
            .when(known, F.struct(s["total"].alias("total"), (s["held"] * 10 + digit(ch)).alias("held"), F.lit(False).alias("over")))
            .otherwise(F.struct(s["total"].alias("total"), s["held"].alias("held"), F.lit(True).alias("over")))
        )

    value = F.aggregate(F.split(text, ""), state, step, lambda s: s["total"] + s["held"])
    return F.when(text == "元", F.lit(1)).otherwise(F.when(value > 0, value))


def regnal_year(text: Column) -> Column:
    """昭和49年 or 昭和四十九年 -> 1974; the first period in REGNAL that gives a year in range."""
    tries = []
    for name, before in REGNAL:
        tries.append(in_range(found_int(text, f"{name}([0-9]{{1,2}})年") + before))
        tries.append(in_range(kanji_number(F.nullif(F.regexp_extract(text, f"{name}([〇一二三四五六七八九十百元]+)年", 1), F.lit(""))) + before))
    return F.coalesce(*tries)


def semicolon_year(text: Column) -> Column:
    """;YYYY-MM-DD, else ;YYYY that no digit follows."""
    return F.coalesce(in_range(found_int(text, r";([0-9]{4})-[0-9]{2}-[0-9]{2}")), in_range(found_int(text, r";([0-9]{4})(?:[^0-9]|$)")))


def disambiguation_year(text: Column) -> Column:
    """（YYYY年の…） or [YYYY]."""
    return F.coalesce(in_range(found_int(text, r"[（(]([0-9]{4})年の")), in_range(found_int(text, r"\[([0-9]{4})\]")))


def generic_year(text: Column) -> Column:
    return in_range(found_int(text, r"([0-9]{4})年"))


def era11(text: Column) -> Column:
    """Era of the first four digits in a text."""
    year = found_int(text, r"([0-9]{4})")
    chain = F.when(year.isNull(), None)
    for bound, name in ERAS11:
        chain = chain.when(year < bound, name)
    return chain.otherwise(LAST_ERA)


def active_year(birth: Column, death: Column) -> Column:
    """Middle of a life; 30 years from the one end that is known. A year of 0 counts as unknown."""
    b, d = F.nullif(birth, F.lit(0)), F.nullif(death, F.lit(0))
    return F.when(b.isNotNull() & d.isNotNull(), F.floor((b + d) / 2)).when(b.isNotNull(), b + 30).when(d.isNotNull(), d - 30).cast("int")
