"""Operator 2: quality rules under weak supervision.

Rules on counted features vote good (+1), bad (-1) or abstain (0). Rows with
the same votes are counted in Spark (at most 3^rules patterns, whatever the
input), and expectation-maximisation over those counts estimates how each
rule votes on good and on bad texts: three probabilities a rule and class, so
a rule's accuracy and its abstentions are both learned. A text's posterior of
being good, not a conjunction of rules, decides.

Base counts per text: words, code points in words, symbols, repeated lines,
words in repeated three-word windows; ``base_failed`` texts are never kept.

Defined cases: null text has no words and is base_failed, as is an empty one;
repeated rows each count and get the same verdict; an empty table gives an
empty result; ties at the threshold keep the text; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD, keyed, map_text, row_hash, spread, staged, table

MIN_WORDS = 50
KEEP_AT = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_letters", "n_upper", "n_bangs", "n_types", "n_text_lines", "n_ended_lines")


def _ascii(characters: str) -> np.ndarray:
    """Which code points are among some ASCII characters; the last entry stands for all others."""
    out = np.zeros(129, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL, _SPACE = _ascii("#*$%&|<>"), _ascii(" \t\n\v\f\r")
_LETTER = _ascii("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128] = True  # beyond ASCII nearly all are letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def repeated_words(codes: np.ndarray, types: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    two = codes[:-1] * types + codes[1:]
    if types > 1000:  # made dense, so that the product below stays in 64 bits
        _, two = np.unique(two, return_inverse=True)
    three = two[:-1] * types + codes[2:]
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(three), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def _counts():
    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in part.column(1).to_pylist():
            text = text or ""
            words = WORD.findall(text)
            ids: dict[str, int] = {}
            codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            seen: set[str] = set()
            dup = lines = ended = 0
            for line in text.split("\n"):
                if WORD.search(line):
                    lines += 1
                    dup += line in seen
                    seen.add(line)
                    ended += line.rstrip()[-1:] in ".!?…。"
            points = _points(text)
            known = np.minimum(points, 128)
            lower = text.lower()
            upper = int((points != _points(lower)).sum()) if len(lower) == len(text) else sum(c != c.lower() for c in text)
            rows.append((len(words), int((~_SPACE[known]).sum()), int(_SYMBOL[known].sum()), dup, repeated_words(codes, len(ids)), int(_LETTER[known].sum()), upper, int((points == 33).sum()), len(ids), lines, ended))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], names=["doc_id", "row", *BASE, *MORE])

    return f


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row's key and the counts in BASE and MORE, one row for each row of ``docs``."""
    return map_text(spread(keyed(docs, id_col, text_col)), _counts, ", ".join(["doc_id long", "row long", *[f"{c} long" for c in BASE + MORE]]))


def _vote(ratio: Column, good: Column, bad: Column) -> Column:
    return F.when(bad & ratio.isNotNull(), -1).when(good & ratio.isNotNull(), 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Each rule's vote as a Column over the features."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    symbols, repeats, dups = share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_text_lines")
    caps, bangs, variety = share("n_upper", "n_letters"), share("n_bangs", "n_words"), share("n_types", "n_words")
    ended, width = share("n_ended_lines", "n_text_lines"), share("word_chars", "n_words")
    n = F.col("n_words")
    return {
        "length": _vote(n, n >= 100, n < MIN_WORDS),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.15),
        "repeats": _vote(repeats, repeats <= 0.1, repeats > 0.3),
        "duplicate_lines": _vote(dups, dups == 0, dups > 0.34),
        "capitals": _vote(caps, caps <= 0.15, caps > 0.35),
        "exclamations": _vote(bangs, bangs <= 0.05, bangs > 0.2),
        "variety": _vote(variety, variety >= 0.35, variety < 0.1),
        "sentence_ends": _vote(ended, ended >= 0.8, ended < 0.4),
        "word_width": _vote(width, (width >= 3) & (width <= 7), (width < 2) | (width > 12)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.9) -> tuple[float, np.ndarray]:
    """EM for two classes and three-valued votes given vote patterns and their counts.

    Returns the share of good texts and log P(vote | class) as [class, rule,
    vote + 1], class 1 being good. It keeps a pseudo-count that
    says rules are right more often than wrong, so the classes can't swap.
    The start holds a text with any bad vote for bad; a rule that then turns
    out to vote bad on texts that all others like loses its weight.
    """
    n_rules = patterns.shape[1]
    ballots = patterns + 1
    good = np.where((patterns == -1).any(1), 0.1, 0.9)
    pseudo = np.array([[4.0, 1.0, 2.0], [0.2, 1.0, 8.0]])[:, None, :].repeat(n_rules, 1)
    share, table_ = prior, np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        for c, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for v in range(3):
                table_[c, :, v] = ((ballots == v) * weight[:, None]).sum(0)
        table_ += pseudo
        logs = np.log(table_ / table_.sum(2, keepdims=True))
        table_ = np.zeros_like(table_)
        share = (float((counts * good).sum()) + 9) / (float(counts.sum()) + 10)
        at = np.arange(n_rules)
        odds = np.log(share) - np.log1p(-share) + (logs[1][at, ballots] - logs[0][at, ballots]).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, good = np.abs(new - good).max(initial=0), new
        if moved < 1e-9:
            break
    return share, logs


def score(features_: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds p_good, base_failed and kept to a table of features; fits the label model on all rows that pass the base rules."""
    votes = rules()
    voted = features_.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    seen = voted.where(~failed).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # at most 3^9 rows
    patterns = np.array([[r[c] for c in names] for r in seen], np.int64).reshape(len(seen), len(names))
    share, logs = fit(patterns, np.array([r["n"] for r in seen], np.float64))
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for i, name in enumerate(names):
        gain = (logs[1, i] - logs[0, i]).tolist()
        odds = odds + F.when(F.col(name) == -1, gain[0]).when(F.col(name) == 1, gain[2]).otherwise(gain[1])
    good = 1 / (1 + F.exp(-odds))
    return voted.select(
        "doc_id", "row", *BASE, failed.alias("base_failed"), (~failed & (good >= keep_at)).alias("kept"), good.alias("p_good"), *names
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the label model's verdict for each document."""
    return score(staged(features(table(spark, sf_dir, "documents")))).drop("row")


def keep_good(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Pipeline stage: documents that the label model keeps. The verdict follows from id and text, so rows with null or shared ids have their own."""
    kept = score(staged(features(docs)), keep_at).where("kept").select(F.col("row").alias("__row")).distinct()
    return docs.join(kept, row_hash() == F.col("__row"), "left_semi").select(docs.columns)
