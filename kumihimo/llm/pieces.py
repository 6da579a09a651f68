"""Operator 10: SentencePiece encoding by sampling, and lossless decoding.

The pieces of a text form a lattice: an edge for each vocabulary piece that
matches at a place, and for a character that no piece holds one edge of its
UTF-8 bytes. Forward filtering sums the weights of all paths to each place;
backward sampling then draws a path in proportion to its weight. No piece has
a space after another character, so the lattice falls apart before each run
of spaces and each chunk (a run of spaces and what follows up to the next) is
drawn alone, with the same result as on the whole lattice.

Uniform numbers come from the row key, the seed and the chunk's number, so a
row's segmentation does not depend on partitions, batches or retries. Within a
task the chunks of many rows are filtered and sampled together as arrays: each
distinct chunk's forward sums are made once for a slice of rows.

Weights: a BPE model holds merge ranks, not log-probabilities, so a piece of
rank r has Zipf's weight 1 / (r + 2); ``sharpness`` is the power put on a path.

Encoding adds no prefix and changes no character: a space is the mark of
pieces, while a mark that stands in the text itself is spelled in bytes. So
decoding gives back every text exactly.

Defined cases: null encodes to null and decodes to null, '' to []; repeated
rows with one key have equal segmentations; a null key counts as 0; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import map_text, mix, spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 0
MARK = "▁"

_U = np.uint64
#: Longer chunks are drawn one by one, with logarithms.
_LONG = 48
#: Rows, and bytes of text, whose chunks are filtered together: the more, the fewer chunks are filtered again.
_ROWS, _BYTES = 1024, 6 << 20
_STEP = 0xD1342543DE82EF95
_GOLD = 0x9E3779B97F4A7C15


class Pieces:
    """Vocabulary of a model file as a trie in arrays, with the pieces' weights."""

    def __init__(self, model: str = MODEL, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {i: r for r, i in enumerate(normal)}
        total = sum(1 / (r + 2) for r in range(len(normal) + 256))
        for i in range(size):
            text = sp.id_to_piece(i)
            if i in rank:
                self.piece[text.replace(MARK, " ")] = (i, (1 / (rank[i] + 2) / total) ** sharpness)
                self.bytes_of[i] = text.replace(MARK, " ").encode()
            elif sp.is_byte(i):
                value = int(text[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
        self.byte_weight = (1 / (len(normal) + 258) / total) ** sharpness
        self.longest = max(map(len, self.piece))
        self.letter: np.ndarray | None = None

    def _trie(self) -> None:
        """Nodes are prefixes of pieces; steps between them are an open hash table on (node, character)."""
        self.letter = np.zeros(0x110000, np.int32)  # of a code point; 0: in no piece, as is the mark
        letters = sorted(set("".join(self.piece)))
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes: dict[str, int] = {"": 0}
        for p in self.piece:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        self.node_id, self.node_weight = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes))
        for p, (i, w) in self.piece.items():
            self.node_id[nodes[p]], self.node_weight[nodes[p]] = i, w
        self.shift = 64 - 19
        self.keys, self.next = np.full(1 << 19, -1, np.int64), np.full(1 << 19, -1, np.int32)
        self.probes = 1
        for p, node in nodes.items():
            if p:
                key = nodes[p[:-1]] << 20 | int(self.letter[ord(p[-1])])
                at, tries = ((key * _GOLD) & (2**64 - 1)) >> self.shift, 1
                while self.keys[at] >= 0:
                    at, tries = (at + 1) & ((1 << 19) - 1), tries + 1
                self.keys[at], self.next[at] = key, node
                self.probes = max(self.probes, tries)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Children of nodes by letters; -1 where there is none."""
        key = node.astype(np.int64) << 20 | letter
        at = ((key.view(_U) * _U(_GOLD)) >> _U(self.shift)).astype(np.int64)
        out = np.where(self.keys[at] == key, self.next[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << 19) - 1)
            found = self.keys[at[open_]]
            out[open_] = np.where(found == key[open_], self.next[at[open_]], -1)
            open_ = open_[(found >= 0) & (out[open_] < 0)]
        return out

    def ending(self, chunk: str, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The edges that end at a place, shortest first: where they begin, weight, ids."""
        out = []
        for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
            hit = self.piece.get(chunk[i:j])
            if hit:
                out.append((i, hit[1], (hit[0],)))
            elif i == j - 1:
                ids = self.spelled(ord(chunk[i]))
                out.append((i, self.byte_weight ** len(ids), ids))
        return out

    def spelled(self, point: int) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in chr(point).encode("utf-8", "surrogatepass"))

    def draw(self, chunk: str, seed: int) -> list[int]:
        """One chunk's path by forward filtering, backward sampling, in logarithms; only the sums of each place are held."""
        logs = [0.0]
        for j in range(1, len(chunk) + 1):
            terms = [logs[i] + math.log(w) for i, w, _ in self.ending(chunk, j)]
            top = max(terms)
            logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        ids: list[tuple[int, ...]] = []
        j, turn = len(chunk), 0
        while j:
            left = float(_uniform(np.array([seed], _U), turn)[0])
            turn += 1
            for e in self.ending(chunk, j):
                left -= math.exp(logs[e[0]] + math.log(e[1]) - logs[j])
                if left < 0:
                    break
            ids.append(e[2])
            j = e[0]
        return list(chain.from_iterable(reversed(ids)))

    def encode(self, texts: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text."""
        if self.letter is None:
            self._trie()
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        total = len(points)
        if not total:
            return [np.zeros(0, np.int32) for _ in texts]
        first = np.append(0, np.cumsum(sizes))[:-1][sizes > 0]
        space = points == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, total))
        doc = np.repeat(np.arange(len(texts)), sizes)[start]
        number = np.arange(len(start)) - np.searchsorted(start, np.append(0, np.cumsum(sizes))[:-1])[doc]
        own = mix(np.array([(k ^ (seed * _GOLD)) & (2**64 - 1) for k in keys], _U))
        draws = mix(own[doc] + (number + 1).astype(_U) * _U(_GOLD))

        where, order, ids = [], [], []  # chunk, place from its end, id; code points spelled in bytes are negative
        short = length <= _LONG
        for n in np.unique(length[short]).tolist():
            here = np.flatnonzero(length == n)
            rows = points[start[here][:, None] + np.arange(n)]
            kinds, back = _distinct(rows)
            cdf, piece = self._filter(kinds)
            for lo in range(0, len(here), 1 << 16):
                self._sample(here[lo : lo + (1 << 16)], back[lo : lo + (1 << 16)], draws, cdf, piece, n, where, order, ids)
        for c in np.flatnonzero(~short).tolist():
            text = points[start[c] : start[c] + length[c]].tobytes().decode("utf-32-le", "surrogatepass")
            path = self.draw(text, int(draws[c]))
            where.append(np.full(len(path), c))
            order.append(np.arange(len(path))[::-1])
            ids.append(np.array(path, np.int64))
        where, order, ids = np.concatenate(where), np.concatenate(order), np.concatenate(ids)
        count = np.bincount(where, minlength=len(start))
        out = np.empty(len(ids), np.int64)
        out[np.cumsum(count)[where] - 1 - order] = ids
        per_doc = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        if (out < 0).any():
            spelled = {p: self.spelled(-1 - p) for p in np.unique(out[out < 0]).tolist()}
            wide = np.ones(len(out), np.int64)
            for p, s in spelled.items():
                wide[out == p] = len(s)
            owner = np.repeat(np.arange(len(texts)), per_doc)
            per_doc = np.bincount(owner, weights=wide, minlength=len(texts)).astype(np.int64)
            at = np.append(0, np.cumsum(wide))[:-1]
            full = np.repeat(out, wide)
            for k in np.flatnonzero(out < 0).tolist():
                full[at[k] : at[k] + wide[k]] = spelled[int(out[k])]
            out = full
        return np.split(out.astype(np.int32), np.cumsum(per_doc)[:-1])

    def _filter(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums for chunks of one length: [chunk, end, size - 1] -> chance that a piece of so many characters ends a path there, cumulated, and its id."""
        many, n = points.shape
        k = min(n, self.longest)
        letters = self.letter[points].astype(np.int64)
        f = np.zeros((many, n + 1))
        f[:, 0] = 1
        cdf = np.zeros((many, n + 1, k))
        piece = np.zeros((many, n + 1, k), np.int32)
        for i in range(n):
            alive = np.arange(many)
            node = np.zeros(many, np.int32)
            for size in range(1, min(k, n - i) + 1):
                node = self.step(node, letters[alive, i + size - 1])
                if size == 1:
                    known = node >= 0
                    known[known] = self.node_id[node[known]] >= 0
                    alone = np.flatnonzero(~known)
                    if len(alone):
                        p = points[alone, i].astype(np.int64)
                        width = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
                        cdf[alone, i + 1, 0] = self.byte_weight ** width * f[alone, i]
                        piece[alone, i + 1, 0] = -1 - p
                keep = node >= 0
                alive, node = alive[keep], node[keep]
                if not len(alive):
                    break
                hit = self.node_id[node] >= 0
                at = alive[hit]
                cdf[at, i + size, size - 1] = self.node_weight[node[hit]] * f[at, i]
                piece[at, i + size, size - 1] = self.node_id[node[hit]]
            f[:, i + 1] = cdf[:, i + 1].sum(1)
        np.cumsum(cdf, axis=2, out=cdf)
        cdf[:, 1:] /= cdf[:, 1:, -1:]
        return cdf, piece

    def _sample(self, chunk, kind, draws, cdf, piece, n, where, order, ids) -> None:
        """Backward sampling of many chunks of one length at once."""
        end = np.full(len(chunk), n)
        turn = 0
        while len(chunk):
            u = _uniform(draws[chunk], turn)
            size = (cdf[kind, end] <= u[:, None]).sum(1)
            size = np.minimum(size, cdf.shape[2] - 1)
            where.append(chunk)
            order.append(np.full(len(chunk), turn))
            ids.append(piece[kind, end, size].astype(np.int64))
            end = end - size - 1
            left = end > 0
            chunk, kind, end = chunk[left], kind[left], end[left]
            turn += 1

    def decode(self, ids) -> str:
        table_ = self.bytes_of
        return b"".join([table_[i] for i in ids]).decode("utf-8", "surrogatepass")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and for each row which it is."""
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
    h = np.zeros(len(rows), _U)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(_U)) * _U(_GOLD)
        h ^= h >> _U(29)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if (flat[first][back] != flat).any():  # two chunks with one hash
        _, first, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return rows[first], back.ravel()


def _uniform(seeds: np.ndarray, turn: int) -> np.ndarray:
    return (mix(seeds + _U((turn + 1) * _STEP & (2**64 - 1))) >> _U(11)).astype(np.float64) * 2.0**-53


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", model: str = MODEL, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``out_col``: the ids of a sampled segmentation of ``text_col``, seeded by ``id_col``."""
    kept = [c for c in docs.columns if c != out_col]
    at_id, at_text = kept.index(id_col), kept.index(text_col)

    def make():
        pieces = Pieces(model, sharpness)

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(at_text).to_pylist()
            keys = [int(k or 0) & (2**64 - 1) for k in part.column(at_id).to_pylist()]
            made = pieces.encode([t or "" for t in texts], keys, seed)
            rows = [None if t is None else ids for t, ids in zip(texts, made, strict=True)]
            offsets = np.append(0, np.cumsum([0 if r is None else len(r) for r in rows])).astype(np.int32)
            flat = np.concatenate([r for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([r is None for r in rows]))
            return pa.RecordBatch.from_arrays([*part.columns, ids], names=[*kept, out_col])

        return f

    narrow = docs.select(*kept)
    schema = T.StructType([*narrow.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()), True)])
    return map_text(spread(narrow), make, schema, at_text, _ROWS, _BYTES)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with ``out_col``: the text that the ids spell."""
    kept = [c for c in encoded.columns if c != out_col]
    at = kept.index(ids_col)

    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(at)
                texts = [None if x is None else pieces.decode(x) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, out_col])

    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField(out_col, T.StringType(), True)])
    return encoded.select(*kept).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and what decoding them gives: decoded_sha256 and whether that is the text itself."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _shown(decode(encoded))


def _shown(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def encode_stage(docs: DataFrame, **options) -> DataFrame:
    """Last pipeline stage: the same columns as the query, for the documents that are left."""
    return _shown(decode(encode(docs.select("doc_id", "text"), **options)))
