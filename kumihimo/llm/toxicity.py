"""Operator 9: toxic spans by a linear-chain conditional random field.

A line is a chain of words with two states, clean and toxic. A word's features
are itself, its beginnings and its end (hashed), folded and without the marks
around it; the chain adds four transition weights. Training
tokens come from labelled documents: a word of a toxic document starts as
toxic where it, or how it begins, is found in toxic training documents and
hardly ever in clean ones; every word of a clean document is clean. The field
is fitted by gradient ascent on the exact likelihood (forward-backward), then
its own marginals add to the labels of toxic documents and it is fitted again.

Marginals give the offending offsets; a document's two largest, and the
expected number and share of its toxic words, go through a logistic
calibration, fitted on the training documents, to its score. Labels are read for fitting only; language, source and id are never
features.

The fit uses at most ``sample`` documents of each label, those with the least
hash of their id. Of a document with more than ``sample_words`` words it takes
so many in pieces of lines chosen by hash from the whole text, in Spark, so
what reaches the driver is bounded. Scoring reads every text whole.

Defined cases: null, empty and wordless texts get the score of a text without
a toxic word; repeated rows each count; documents without a label are scored
only; with no usable label of either kind all scores are 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD, map_text, slices, spread, table

BITS = 17
#: Training chains are cut to so many words; scored ones are whole lines.
_PIECE = 64
SAMPLE = 1500
SAMPLE_WORDS = 4000
SPAN_AT = 0.5
TOXIC_AT = 0.7

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+|\n")
_MARKS = string.punctuation + "…“”„«»‘’¡¿–—"


def bare(word: str) -> str:
    """The word folded, without the marks around it."""
    return word.strip(_MARKS).lower()


def word_features(word: str, bits: int = BITS) -> list[int]:
    """Hashed features of one word."""
    w = bare(word)
    if not w:
        return [0]
    mask, h, n = (1 << bits) - 1, zlib.crc32, len(w)
    data = w.encode("utf-8", "surrogatepass")
    out = [h(data) & mask or 1]
    for k in (4, 5, 6):
        if n > k:
            out.append(h(w[:k].encode("utf-8", "surrogatepass"), k) & mask or 1)
    if n > 4:
        out.append(h(w[-4:].encode("utf-8", "surrogatepass"), 99) & mask or 1)
    return out


class Chains:
    """Many chains of word numbers, laid out by place so that all of them advance together."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[order]
        start = np.append(0, np.cumsum(lengths))[:-1]
        begin = np.append(0, np.cumsum(self.lengths))[:-1]
        longest = int(self.lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-self.lengths, -np.arange(longest), "left")  # chains longer than t
        self.steps = [begin[:a] + t for t, a in enumerate(active.tolist())]
        offset = np.arange(len(flat)) - np.repeat(begin, self.lengths)
        source = np.repeat(start[order], self.lengths) + offset
        self.words = flat[source]
        self.given = np.empty(len(flat), np.int64)  # inner place of each token, in the order given
        self.given[source] = np.arange(len(flat))

    def marginals(self, emission: np.ndarray, move: np.ndarray, totals: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
        """P(toxic) of each token (in inner order), summed pair marginals [from, to], and the log partition.

        emission: log-odds of toxic for each token. move: transition scores.
        Two states, so a message is one log-odds: forward r, backward s.
        """
        e = emission
        r, s = np.zeros(len(e)), np.zeros(len(e))
        fwd = lambda x: np.logaddexp(move[0, 1], move[1, 1] + x) - np.logaddexp(move[0, 0], move[1, 0] + x)
        bwd = lambda x: np.logaddexp(move[1, 0], move[1, 1] + x) - np.logaddexp(move[0, 0], move[0, 1] + x)
        log_z = 0.0
        for t, at in enumerate(self.steps):
            if t == 0:
                r[at] = e[at]
            else:
                before = r[self.steps[t - 1][: len(at)]]
                if totals:
                    log_z += float(np.logaddexp(move[0, 0], move[1, 0] + before).sum())
                r[at] = e[at] + fwd(before)
            if not totals:
                continue
            last = at[len(self.steps[t + 1]) if t + 1 < len(self.steps) else 0 :]
            log_z += float(np.logaddexp(0, r[last]).sum())
        # r is relative to state 0, whose own mass log_z gathers step by step: each logaddexp above is the factor taken out
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 2, -1, -1):
            nxt = self.steps[t + 1]
            at = self.steps[t][: len(nxt)]
            after = e[nxt] + s[nxt]
            s[at] = bwd(after)
            if not totals:
                continue
            left = r[at]
            top = np.stack([np.full(len(at), move[0, 0]), move[0, 1] + after, left + move[1, 0], left + move[1, 1] + after])
            top = np.exp(top - top.max(0))
            pairs += (top / top.sum(0)).sum(1).reshape(2, 2)
        return 1 / (1 + np.exp(-np.clip(r + s, -60, 60))), pairs, log_z


class Vocabulary:
    """Numbers of word types and their features in one flat list."""

    def __init__(self, bits: int):
        self.bits, self.index = bits, {}
        self.flat: list[int] = []
        self.ends: list[int] = []

    def number(self, word: str) -> int:
        n = self.index.get(word)
        if n is None:
            n = self.index[word] = len(self.ends)
            self.flat += word_features(word, self.bits)
            self.ends.append(len(self.flat))
        return n

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[np.asarray(self.flat, np.int64)], np.append(0, self.ends[:-1])) if self.ends else np.zeros(0)


def pieces(text: str, most: int) -> list[str]:
    """The lines of a text in pieces of _PIECE words; of a text of more than ``most`` words the pieces with the least hashes, in their order."""
    out = []
    for line in text.split("\n"):
        words = WORD.findall(line)
        out += [" ".join(words[lo : lo + _PIECE]) for lo in range(0, len(words), _PIECE)]
    sizes = np.array([x.count(" ") + 1 for x in out], np.int64)
    if sizes.sum() <= most:
        return out
    order = sorted(range(len(out)), key=lambda i: (zlib.crc32(out[i].encode("utf-8", "surrogatepass"), i), i))
    left = np.cumsum(sizes[order])
    return [out[i] for i in sorted(order[: max(1, int(np.searchsorted(left, most, "right")))])]


def _suspects(lines: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words, and beginnings of words as '~...', of toxic documents that clean ones hardly hold. Equal lines count once, so copies add nothing."""
    seen: list[Counter] = [Counter(), Counter()]
    known: set[tuple[int, str]] = set()
    for own, label in zip(lines, toxic.tolist(), strict=True):
        for line in own:
            if (label, line) not in known:
                known.add((label, line))
                forms = {bare(w) for w in line.split(" ")}
                seen[label].update({*forms, *(f"~{f[:n]}" for f in forms for n in (4, 5) if len(f) > n)})
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    least = max(3, 0.012 * n1)
    return {k for k, c in seen[1].items() if k not in ("", "~") and c >= least and c / n1 >= 25 * (seen[0][k] + 0.25) / n0}


def fit(lines: list[list[str]], toxic: np.ndarray, bits: int = BITS, rounds: int = 2, steps: int = 30) -> dict:
    """Weights of features and moves, and the calibration, from the pieces of documents and their labels."""
    vocabulary = Vocabulary(bits)
    suspects = _suspects(lines, toxic)
    numbers, lengths, doc, tags = [], [], [], []
    for k, (own, label) in enumerate(zip(lines, toxic.tolist(), strict=True)):
        for line in own:
            words = line.split(" ")
            lengths.append(len(words))
            for word in words:
                numbers.append(vocabulary.number(word))
                doc.append(k)
                form = bare(word) if label else ""
                tags.append(bool(form) and (form in suspects or any(len(form) > n and f"~{form[:n]}" in suspects for n in (4, 5))))
    if not numbers:
        return {"weights": np.zeros(1 << bits), "move": np.zeros((2, 2)), "bias": -20.0, "calibration": (-20.0, *[0.0] * 4), "bits": bits}
    chains = Chains(np.array(numbers, np.int64), np.array(lengths, np.int64))
    doc = np.array(doc, np.int64)
    tags = np.array(tags, float)
    inner = np.argsort(chains.given)  # given order from inner order
    kind = chains.words
    flat = np.asarray(vocabulary.flat, np.int64)
    owner = np.repeat(np.arange(len(vocabulary.ends)), np.diff(np.append(0, vocabulary.ends)))
    weights, move = np.zeros(1 << bits), np.zeros((2, 2))
    m1, m2 = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    count = 0
    bias = -2.0
    for r in range(rounds):
        y = tags[inner]
        gold_pairs = np.zeros((2, 2))
        for t in range(len(chains.steps) - 1):
            nxt = chains.steps[t + 1]
            at = chains.steps[t][: len(nxt)]
            gold_pairs += np.bincount((2 * y[at] + y[nxt]).astype(int), minlength=4).reshape(2, 2)
        for _ in range(steps):
            e = vocabulary.emissions(weights)[kind] + bias
            p, pairs, _ = chains.marginals(e, move)
            by_type = np.bincount(kind, weights=y - p, minlength=len(vocabulary.ends))
            g = np.bincount(flat, weights=by_type[owner], minlength=len(weights)) - 0.02 * weights
            g = np.append(g, (gold_pairs - pairs - 0.5 * move).ravel())
            count += 1
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            move_by = 0.25 * (m1 / (1 - 0.9**count)) / (np.sqrt(m2 / (1 - 0.99**count)) + 1e-6)
            weights += move_by[:-4]
            move += move_by[-4:].reshape(2, 2)
        p, _, _ = chains.marginals(vocabulary.emissions(weights)[kind] + bias, move)
        given = p[chains.given]
        if r + 1 < rounds:
            tags = np.maximum(tags, (given > 0.5) & (toxic[doc] == 1))
    beta = logistic(document_features(given, doc, len(lines)), toxic)
    return {"weights": weights, "move": move, "bias": bias, "calibration": tuple(beta.tolist()), "bits": bits}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the likelihood rises. The first column is the constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale

    def value(b: np.ndarray) -> float:
        m = z @ b
        return float((y * m - np.logaddexp(0, m)).sum() - 0.5 * ridge * (b[1:] ** 2).sum())

    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        move = np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + penalty, z.T @ (y - mu) - penalty @ b)
        size = 1.0
        while size > 1e-6 and value(b + size * move) < value(b):
            size /= 2
        b = b + size * move
        if np.abs(size * move).max() < 1e-6:
            break
    b = b / scale
    b[0] -= float(b[1:] @ mean[1:])
    return b


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def document_features(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Of each document: 1, its two largest marginals as log-odds, and the log of the expected number and share of toxic words."""
    order = np.lexsort((-p, doc))
    d = doc[order]
    start = np.searchsorted(d, np.arange(docs))
    size = np.searchsorted(d, np.arange(docs), "right") - start
    first, second = np.zeros(docs), np.zeros(docs)
    first[size > 0] = p[order[start[size > 0]]]
    second[size > 1] = p[order[start[size > 1] + 1]]
    expected = np.bincount(doc, weights=p, minlength=docs)
    return np.stack([np.ones(docs), _logit(first), _logit(second), np.log(expected + 0.01), np.log(expected / (size + 20) + 1e-4)], 1)


class Scorer(dict):
    """A fitted field; as a dict it holds the emissions of words seen, up to a bound. A line break is nan."""

    def __init__(self, model: dict, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit
        self["\n"] = float("nan")

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
            self["\n"] = float("nan")
        out = self[word] = float(self.model["weights"][word_features(word, self.model["bits"])].sum()) + self.model["bias"]
        return out

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The marginal and the document of each word; lines are chains."""
        found = [_TOKEN.findall(t) for t in texts]
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.float64)
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        breaks = np.isnan(flat)
        new = np.append(True, (doc[1:] != doc[:-1]) | breaks[:-1] | breaks[1:]) if len(flat) else breaks
        line = np.cumsum(new)[~breaks]
        flat, doc = flat[~breaks], doc[~breaks]
        if not len(flat):
            return flat, doc
        cuts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        chains = Chains(flat, np.diff(np.append(cuts, len(flat))))
        p, _, _ = chains.marginals(chains.words, self.model["move"], totals=False)
        return p[chains.given], doc

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        p, doc = self.tokens(texts)
        x = document_features(p, doc, len(texts))
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(self.model["calibration"]), -60, 60)))
        spans = [""] * len(texts)
        begin = np.searchsorted(doc, np.arange(len(texts)))
        hits: dict[int, list[int]] = {}
        for at in np.flatnonzero(p >= SPAN_AT).tolist():
            hits.setdefault(int(doc[at]), []).append(at - int(begin[doc[at]]))
        for k, places in hits.items():
            words = [m.span() for m in WORD.finditer(texts[k])]
            spans[k] = ",".join(f"{words[i][0]}:{words[i][1]}" for i in places)
        return score, spans


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out; a null id is never trained on, and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> tuple[list[list[str]], np.ndarray]:
    """Pieces of at most ``sample`` texts of each label that aren't held out: those with the least hash of their id."""

    def cut(batches):
        for part in slices(batches, 1, rows=64):
            made = [pieces(t or "", sample_words) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.string())), part.column(2)], names=["doc_id", "lines", "toxic"])

    known = labels.where("doc_id is not null").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 * sample rows, so this side may be broadcast; of rows that share an id one is used
    first = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    rows = first.mapInArrow(cut, "doc_id long, lines array<string>, toxic int").orderBy("doc_id").collect()
    return [list(r["lines"]) for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_words, toxic_spans (start:end in code points, comma-joined)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines, toxic = training_rows(narrow, labels, sample, sample_words)
    if len(set(toxic.tolist())) < 2:
        return narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_toxic_words"), F.lit("").alias("toxic_spans"))
    model = fit(lines, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            score, spans = scorer.scores([t or "" for t in part.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans)], names=["doc_id", "score", "toxic_spans"])

        return f

    scored = map_text(spread(narrow), make, "doc_id long, score double, toxic_spans string")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.when(F.col("toxic_spans") == "", 0).otherwise(F.size(F.split("toxic_spans", ","))).cast("long").alias("n_toxic_words"),
        "toxic_spans",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from labels that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
