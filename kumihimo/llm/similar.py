"""Groups of sets compared in Spark without all their pairs as rows: what operators 4 and 11 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import list_array, mix, staged

#: A group is compared whole, in one task, if the number of its sets times what they hold is at most this.
WORK = 1 << 31
#: Shingles that a task holds at a time.
HELD = 1 << 21
#: Representatives of a large group at the first level, and by how much their number grows from level to level.
WIDTH = 8
GROWTH = 8
#: What is left open in a group of at most so many times WORK is compared in blocks.
BRUTE = 256

_U = np.uint64


def longs(parts: list[np.ndarray]) -> pa.ListArray:
    """A column of lists of longs from arrays of 64-bit hashes."""
    lists = list_array(parts, np.uint64, pa.uint64())
    return pa.ListArray.from_arrays(lists.offsets, lists.values.view(pa.int64()))


def needed(sums: np.ndarray, threshold: float) -> np.ndarray:
    """Least number of shared shingles with which two sets of together ``sums`` reach the threshold."""
    return np.ceil((threshold * sums - 1e-9) / (1 + threshold)).astype(np.int64)


def agreeing(rows: np.ndarray, others: np.ndarray, some: np.ndarray | int) -> np.ndarray:
    """Equal bytes of signatures: rows [some] against others; a signature has 128 bytes, so eight are counted at a time."""
    same = (rows[some][..., None, :] == others).view(_U).sum(-1, dtype=_U)
    return ((same * _U(0x0101010101010101)) >> _U(56)).astype(np.int64)


class Exact:
    """Sets by all their shingles."""

    step = 64

    def __init__(self, sizes: np.ndarray, data: pa.ListArray, threshold: float):
        self.sizes, self.threshold = sizes, threshold
        self.flat = data.flatten().to_numpy(zero_copy_only=False).view(_U)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        _, col = np.unique(self.flat, return_inverse=True)
        often = np.bincount(col) > 1
        keep = often[col]
        self.col, self.of = (np.cumsum(often) - 1)[col[keep]], self.owner[keep]
        self.vocabulary = int(often.sum())
        self.start = np.searchsorted(self.of, np.arange(len(sizes) + 1))

    def one(self, lead: int, others: np.ndarray) -> np.ndarray:
        """Whether a set is near to some others."""
        own = self.col[self.start[lead] : self.start[lead + 1]]
        lengths = self.start[others + 1] - self.start[others]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.start[others] - (ends - lengths), lengths)
        hits = np.append(0, np.cumsum(np.isin(self.col[at], own, assume_unique=False, kind="table" if self.vocabulary < 1 << 24 else None)))
        both = hits[ends] - hits[ends - lengths]
        return both >= self.threshold * (self.sizes[others] + self.sizes[lead] - both) - 1e-9

    def near(self, leads: np.ndarray) -> np.ndarray:
        n = len(self.sizes)
        out = np.zeros((len(leads), n), bool)
        held = np.zeros(self.vocabulary, bool)
        for i, k in enumerate(leads.tolist()):
            own = self.col[self.start[k] : self.start[k + 1]]
            held[own] = True
            both = np.bincount(self.of[held[self.col]], minlength=n)
            held[own] = False
            both[k] = self.sizes[k]
            out[i] = both >= self.threshold * (self.sizes + self.sizes[k] - both) - 1e-9
        return out


def linked(sets, ids: np.ndarray, leads: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``leads`` to the sets ``allowed``, a few leads at a time -> links of each set, and the least id of each one's component."""
    n = len(ids)
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    count = np.zeros(n, np.int64)
    ordered = np.sort(ids)
    for lo in range(0, len(leads), sets.step):
        some = leads[lo : lo + sets.step]
        near = sets.near(some) & allowed[None, :] & (ids[some][:, None] != ids[None, :])
        count += near.sum(0)
        count[some] += near.sum(1)
        for k, row in zip(some.tolist(), near, strict=True):
            met = np.unique(label[row])
            if len(met) and (len(met) > 1 or met[0] != label[k]):
                met = np.append(met, label[k])
                label[np.isin(label, met)] = met.min()
    return count, ordered[label]


def spanned(sets, ids: np.ndarray) -> np.ndarray:
    """The least id of each one's component. A pair that is in one component already is not compared."""
    n = len(ids)
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    ordered = np.sort(ids)
    for k in range(n - 1):
        others = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        if not len(others):
            continue
        met = np.unique(label[others[sets.one(k, others)]])
        if len(met):
            met = np.append(met, label[k])
            label[np.isin(label, met)] = met.min()
            if not (label != label[0]).any():
                break
    return ordered[label]


def _whole(kind, threshold: float, counting: bool):
    """Groups as lists of members -> rep, n_links (0 where they are not counted) and root (the least rep of its component) for each member with a link."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            cuts, each = lists.offsets.to_numpy(), lists.values
            reps, sizes = (each.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "size"))
            out = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets, ids = kind(sizes[lo:hi], each.field("data").slice(lo, hi - lo), threshold), reps[lo:hi]
                if counting:  # each link is counted from both its ends
                    count, root = linked(sets, ids, np.arange(hi - lo), np.ones(hi - lo, bool))
                    some = count > 0
                    out.append((ids[some], count[some] // 2, root[some]))
                else:
                    root = spanned(sets, ids)
                    some = root != ids
                    out.append((ids[some], np.zeros(some.sum(), np.int64), root[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["rep", "n_links", "root"])

    return run


def compared_whole(members: DataFrame, kind, threshold: float, counting: bool = False) -> DataFrame:
    """members: key, rep, size, data of groups that fit a task -> rep, n_links, root."""
    lists = members.groupBy("key").agg(F.collect_list(F.struct("rep", "size", "data")).alias("members")).select("members")
    return lists.mapInArrow(_whole(kind, threshold, counting), "rep long, n_links long, root long")


def _crossed(kind, threshold: float):
    """Two blocks of a group (or one with itself) -> links found there of each set, and the root of its component there."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        reps, sizes, part = (column(c).to_numpy(zero_copy_only=False) for c in ("rep", "size", "part"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = kind(sizes, column("data"), threshold)
        count, root = linked(sets, reps, np.flatnonzero(part == i), part == j)
        some = count > 0
        return pa.table([pa.array(reps[some]), pa.array(count[some] // (2 if i == j else 1)), pa.array(root[some])], names=["rep", "n_links", "root"])

    return run


def compared_in_blocks(members: DataFrame, kind, threshold: float, held: int) -> DataFrame:
    """members: key, rep, size, total, data of groups of any size -> rep, n_links, root (several rows a rep).

    A group is dealt into blocks of about half of ``held``; every pair of
    blocks is one task's. So every pair of sets is compared, none is a row,
    and a set is sent once for each block.
    """
    blocks = F.ceil(F.col("total") * 2 / held).cast("int")
    rows = members.withColumn("parts", blocks).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "size", "data")
    return rows.groupBy("key", "i", "j").applyInArrow(_crossed(kind, threshold), "rep long, n_links long, root long")


def _held_against(kind, threshold: float, splits: int):
    """One part of a large group: its representatives and some members -> for each member the root of what it is near to and its next keys; and links between representatives."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        sizes, reps, lead = (column(c).to_numpy(zero_copy_only=False) for c in ("size", "rep", "lead"))
        sets = kind(sizes, column("data"), threshold)
        leads, members = np.flatnonzero(lead), np.flatnonzero(~lead)
        near = np.zeros((len(leads), len(members)), bool)
        for lo in range(0, len(leads), sets.step):
            near[lo : lo + sets.step] = sets.near(leads[lo : lo + sets.step])[:, members]
        n = len(leads)
        order = np.lexsort((reps[leads], -column("score").to_numpy(zero_copy_only=False)[leads]))
        label = np.empty(n, np.int64)
        label[order] = np.arange(n)
        while True:  # representatives that meet at a member have one root, the one of the highest score
            at = np.where(near, label[:, None], n).min(0, initial=n)
            to = np.minimum(label, np.where(near, at[None, :], n).min(1, initial=n))
            if (to == label).all():
                break
            label = to
        names = reps[leads][order]
        root = np.where(at < n, names[np.minimum(at, max(n - 1, 0))], reps[members])
        key = _U(int(group.column("key")[0].as_py()) & (2**64 - 1))
        seeds = mix(np.arange(1, splits + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ key) if splits else None
        following = sets.split(seeds) if splits else [np.array([key])] * len(sizes)
        took = np.append(members, leads)
        roots = np.append(root, names[label])
        return pa.Table.from_arrays(
            [*(group.column(c).take(pa.array(took)) for c in ("key", "rep", "size", "held", "score", "led", "lead")), pa.array(roots), longs([*(following[i] for i in members.tolist()), *[np.zeros(0, _U)] * n])],
            names=["key", "rep", "size", "held", "score", "led", "lead", "root", "next"],
        )

    return run


_HELD_ROWS = "key long, rep long, size long, held long, score long, led boolean, lead boolean, root long, next array<long>"


def _left_open(kind, threshold: float):
    """Two blocks of a group -> edges between components, from the sets that are neither in the group's main one nor were representatives, against all sets."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        sizes, part, label, main, led = (column(c).to_numpy(zero_copy_only=False) for c in ("size", "part", "label", "main", "led"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = kind(sizes, column("data"), threshold)
        names, at = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        free = (label != main) & ~led
        for leads, others in ((np.flatnonzero(free & (part == i)), part == j), *(((np.flatnonzero(free & (part == j)), (part == i) & ~free),) if i != j else ())):
            for k in leads.tolist():
                seen = np.flatnonzero(others & (root[at] != root[at[k]]))
                if i == j:
                    seen = seen[~free[seen] | (seen > k)]
                if len(seen):
                    met = np.unique(root[at[seen[sets.one(k, seen)]]])
                    if len(met):
                        met = np.append(met, root[at[k]])
                        root[np.isin(root, met)] = met.min()
        moved = root != np.arange(len(names))
        return pa.table([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])

    return run


def joined(groups: DataFrame, payload: DataFrame, kind, threshold: float, work: int, held: int, splits: int = 0, width: int = WIDTH, growth: int = GROWTH, brute: int = BRUTE) -> DataFrame:
    """Edges (a, b) that connect whatever links inside groups connect.

    groups: key, rep, size, held (what a set counts for), score; payload: rep,
    data of a ``kind`` of set. A group is compared whole if the number of its
    sets times what they count for is at most ``work``. In a larger one some
    sets are representatives, and all members are held against them. What is
    linked so far is one component. A group is settled, and ends, when each of
    its sets is in the component of the most of them, or has been a
    representative, which has met all: then no pair is left whose link could
    join anything. What is left open in a group of at most ``brute`` times
    ``work`` is held against all its sets in blocks, and the group ends. In a
    larger one more sets lead, ``growth`` times as many a level; ``splits`` > 0
    instead splits it into the groups of sampled tokens, in so many runs.
    Blocks and parts that a task holds count for ``held`` at most.
    """
    state = groups.select("key", "rep", "size", "held", "score", F.col("rep").alias("label"), F.lit(False).alias("led"))
    edges = groups.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    fits = (F.col("n") * F.col("total") <= work) & (F.col("total") <= held)
    level = 0
    while True:
        by_label = state.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("held").alias("total"), F.count_if("led").alias("led"))
        sizes = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max_by("label", "n").alias("main"), F.sum(F.col("n") - F.col("led")).alias("unled"), F.max_by(F.col("n") - F.col("led"), "n").alias("calm"))
        sizes = staged(sizes.where("n > 1 and unled > calm").drop("unled", "calm"))
        middle = ~fits & (F.col("n") * F.col("total") <= brute * work) & F.lit(level > 0)
        large = ~fits & ~middle
        counts = sizes.agg(*[F.count_if(x).alias(n) for n, x in (("small", fits), ("middle", middle), ("large", large))]).first()
        if not any(counts):
            return edges
        live = state.join(sizes, "key")
        if sum(map(bool, counts)) > 1 or counts["large"]:  # read more than once
            live = staged(live)
        if counts["small"]:
            edges = edges.unionByName(compared_whole(live.where(fits).join(payload, "rep"), kind, threshold).select(F.col("rep").alias("a"), F.col("root").alias("b")))
        if counts["middle"]:
            rows = live.where(middle).join(payload, "rep").withColumn("parts", F.ceil(F.col("total") * 2 / held).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
            pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "size", "label", "main", "led", "data")
            edges = edges.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(_left_open(kind, threshold), "a long, b long"))
        if not counts["large"]:
            return edges
        great = live.where(large)
        slots = width * growth ** (0 if splits else level)
        order = F.xxhash64("rep", "key", F.lit(level))
        free = great.where("not led and label <> main")
        chosen = free.groupBy("key", F.pmod(order, F.lit(slots)).alias("slot")).agg(F.min_by("rep", order).alias("rep")).select("key", "rep")
        hub = free.groupBy("key").agg(F.max_by("rep", F.struct("score", "rep")).alias("rep"))
        leads = chosen.unionByName(hub).distinct().withColumn("leads", F.lit(True))
        marked = great.join(leads, ["key", "rep"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))).withColumn("led", F.col("led") | F.col("leads"))
        rows = marked.join(payload, "rep").withColumn("parts", F.ceil(F.col("total") * 4 / held).cast("int"))
        columns = ["key", "part", "rep", "size", "held", "score", "led", "lead", "data"]
        members = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("lead", F.lit(False))
        heads = rows.where("leads").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lead", F.lit(True))
        both = members.select(columns).unionByName(heads.select(columns))
        # a group that was large and is met again is split, if it is to be, into groups that may end
        out = staged(both.groupBy("key", "part").applyInArrow(_held_against(kind, threshold, splits if level else 0), _HELD_ROWS))
        edges = staged(edges.unionByName(out.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).distinct())
        classes = components(edges).select(F.col("node").alias("rep"), F.col("class").alias("label"))
        following = out.where("not lead").select(F.explode("next").alias("key"), "rep", "size", "held", "score", "led")
        state = following.join(classes, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        level += 1
