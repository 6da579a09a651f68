"""Operator 7: token counts of sections by offset-mapped attribution.

Each whole text is encoded once. The byte lengths of the tokens give their
spans; sections are spans too (by default the lines, each with its line
break), and the two sorted lists are joined as intervals. A token that
crosses a boundary is allotted by a rule that the caller names:

- ``start``: to the section that holds its first character (the default);
- ``majority``: to the section that holds most of its bytes, the earlier one
  on a tie;
- ``split``: to each section in proportion to its bytes.

So the counts of a text's sections always sum to the tokens of the text.

Defined cases: null and empty texts have one empty section 0 without tokens;
an empty section (the last, after a final line break) has none; repeated rows
each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import VOCABULARY, encode, encoder
from .text import map_text, spread, table

RULES = ("start", "majority", "split")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens in each section. bounds: sections' byte starts; the last section has no end."""
    n = len(bounds)
    if not len(starts):
        return np.zeros(n)
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    for t in np.flatnonzero(~whole):
        cuts = np.concatenate([[starts[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]])
        share = np.diff(cuts) / (ends[t] - starts[t])
        if rule == "split":
            out[first[t] : last[t] + 1] += share
        else:
            out[first[t] + int(np.argmax(share))] += 1
    return out


def _sections(rule: str, vocabulary: str):
    def make():
        coder = encoder(vocabulary)
        lengths = np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.max_token_value + 1)], np.int64)

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            repeat, number, begin, end, count = [], [], [], [], []
            for text in part.column(1).to_pylist():
                data = (text or "").encode()
                raw = np.frombuffer(data, np.uint8)
                bounds = np.append(0, np.flatnonzero(raw == 10) + 1)
                ids = np.array(encode(coder, text or ""), np.int64)
                ends = np.cumsum(lengths[ids]) if len(ids) else ids
                count.append(attribute(ends - lengths[ids], ends, bounds, rule))
                chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
                begin.append(chars[bounds])
                end.append(np.append(chars[bounds[1:]], chars[-1]))
                repeat.append(len(bounds))
                number.append(np.arange(len(bounds)))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), repeat)))
            flat = [np.concatenate(x) for x in (number, begin, end)]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in flat], pa.array(np.concatenate(count))], names=["doc_id", "section", "start", "end", "n_tokens"])

        return f

    return make


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section (from 0), start, end (code points), n_tokens (double) for each line of each text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(spread(narrow), _sections(rule, vocabulary), "doc_id long, section long, start long, end long, n_tokens double")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, boundary-crossing ones counted where they start."""
    counted = section_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))
