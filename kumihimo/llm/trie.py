"""Operator 13: the conversation prefix trie, rolled up by centroid decomposition.

Conversations are rebuilt: the first h turns of conversation c - c % 20, then
c's own turns after its first h, with h = crc32(c) % 4. Each distinct sequence
of first turns is a node; its key is the exclusive or of hashes of (position,
role, text) in two independent 64-bit parts, so a running aggregate over a
conversation gives the keys of all its prefixes. Texts do not travel past
their first row: a turn is two hashes and a count of words.

Sums over subtrees need no walk from leaves to the root, of which a long
conversation would need as many steps as it has turns. A component (at first
the whole tree) has as its centroid the deepest node that holds half of the
component's weight or more; the weight of a node is the number of turns that
conversations have at it and below, which one grouped sum gives. The centroid
is taken out: what hangs below it falls into components of their own, and the
total of what was at and below it is added to each node on the path from the
centroid to the component's top. As weights halve, the levels grow with the
logarithm of the turns. All components are split at once, by joins; one of at
most ``limit`` nodes is split further in a task, in the same way. A path comes
from the conversation that stands for the centroid, not from walking.

Result: one row for each node, the textless root included.

Defined cases: null roles and texts are ''; null turns come first; turns that
are equal in number go by hashes of role and text; rows without conv_id belong
to no conversation and make no node; a conversation may be rebuilt to no turns
(it then ends in the root); an empty table gives the root alone, with no
conversation: conv_id null, n_convs 0; other columns are ignored. One
conversation's turns are sorted in one task (on disk if they are many).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import staged, table

#: Components of at most so many nodes are split in one task.
LIMIT = 4096
#: Conversations whose ids differ in their last bits only are written together into the text that is hashed.
ID_BITS = 12

_WORDS = r"[^\x20\x09-\x0D]+"


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """-> turns (c, d, h1, h2, words) of rebuilt conversations by depth d, and all conversations (c, total)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    given = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(13), role, text).alias("h2"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")
    )
    turns = staged(given.withColumn("pos", F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "h1", "h2"))).drop("turn"))
    h = (F.crc32(F.col("c").cast("string")) % 4).cast("int")
    heads = turns.where("pos <= 3").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head")).withColumnRenamed("c", "root")
    convs = turns.groupBy("c").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("root", F.expr("c - c % 20"))
    convs = convs.join(heads, "root", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:int,h1:bigint,h2:bigint,words:bigint>>")), 1, F.col("h")))
    convs = staged(convs.withColumn("taken", F.size("head")).withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    first = convs.select("c", F.explode("head").alias("x")).select("c", F.col("x.pos").alias("d"), "x.h1", "x.h2", "x.words")
    own = turns.where(F.col("pos") > h).join(convs.select("c", "taken"), "c").select("c", (F.col("pos") - h + F.col("taken")).alias("d"), "h1", "h2", "words")
    return first.unionByName(own), convs.select("c", "total")


def _parts(parents: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Subtree sums of a tree by centroids. Nodes are ordered by depth; parents hold positions, -1 for the top."""
    out = [[0, 0] for _ in parents]
    waiting = [list(range(len(parents)))]
    above = list(parents)
    while waiting:
        nodes = waiting.pop()
        if len(nodes) == 1:
            v = nodes[0]
            out[v][0] += values[v][0]
            out[v][1] += values[v][1]
            continue
        size = dict.fromkeys(nodes, 1)
        for v in reversed(nodes[1:]):
            size[above[v]] += size[v]
        centre = min((v for v in nodes if 2 * size[v] >= len(nodes)), key=size.__getitem__)
        part: dict[int, int] = {}  # of what is below the centroid: the child of it that it hangs from
        pieces: dict[int, list[int]] = {}
        upper = []
        a, b = values[centre]
        for v in nodes:
            if v == centre:
                continue
            top = v if above[v] == centre else part.get(above[v], -1)
            if top < 0:
                upper.append(v)
                continue
            part[v] = top
            pieces.setdefault(top, []).append(v)
            a += values[v][0]
            b += values[v][1]
        v, last = centre, nodes[0]
        while True:
            out[v][0] += a
            out[v][1] += b
            if v == last:
                break
            v = above[v]
        waiting.extend(pieces.values())
        if upper:
            waiting.append(upper)
    return out


def _in_task(batches):
    """Components, sorted by (comp, depth) -> sums of their nodes' subtrees within the component."""

    def done(rows):
        at = {r[0]: i for i, r in enumerate(rows)}
        return [(r[0], *s) for r, s in zip(rows, _parts([-1, *(at[r[1]] for r in rows[1:])], [(r[2], r[3]) for r in rows]), strict=True)]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["id", "leaves", "saved"])

    comp, held, out = None, [], []
    for part in batches:
        for key, *row in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
            if held and key != comp:
                out += done(held)
                held = []
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            comp = key
            held.append(row)
    if held:
        out += done(held)
    if out:
        yield batch(out)


def rollup(nodes: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sums over subtrees -> (id, leaves, saved).

    nodes: id, parent, conv (whose path goes through the node), depth, weight
    (of the subtree; more than any child's), leaves, saved: the node's own, of
    one tree whose top has id 0. paths: (c, d, id, parent), the nodes of the
    conversations in conv.
    """
    state = nodes.withColumn("comp", F.lit(0).cast("long")).withColumnRenamed("weight", "w")
    added, small = None, None
    ids = ["id", "parent", "conv", "depth", "leaves", "saved"]
    while True:
        stats = state.groupBy("comp").agg(F.count("*").alias("n"), F.max("w").alias("total"))
        sized = staged(state.join(stats, "comp"))
        rest = sized.where(F.col("n") <= limit).select("comp", "depth", "id", "parent", "leaves", "saved")
        small = rest if small is None else small.unionByName(rest)
        big = sized.where(F.col("n") > limit)
        if big.isEmpty():
            break
        centre = big.where("2 * w >= total").groupBy("comp").agg(F.min_by(F.struct("id", "conv", "depth", "w"), "w").alias("z"))
        centre = staged(centre.select("comp", F.col("z.id").alias("z"), F.col("z.conv").alias("zc"), F.col("z.depth").alias("zd"), F.col("z.w").alias("zw")))
        path = centre.join(paths, (F.col("zc") == F.col("c")) & (F.col("d") <= F.col("zd"))).select("comp", "id").withColumn("on", F.lit(True))
        step = big.drop("n", "total").join(centre.drop("zc"), "comp").join(path, ["comp", "id"], "left").withColumn("under", F.when(F.col("depth") > F.col("zd"), F.col("zd") + 1))
        ahead = paths.select("c", "d", F.col("id").alias("branch"), F.col("parent").alias("from"))
        step = step.join(ahead, (F.col("conv") == F.col("c")) & (F.col("under") == F.col("d")), "left")
        below = F.coalesce(F.col("from") == F.col("z"), F.lit(False))
        on = F.coalesce("on", F.lit(False))
        step = staged(step.select("comp", *ids, "w", "z", "zw", below.alias("below"), on.alias("on"), "branch"))
        sums = step.where("below or id = z").groupBy("comp").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        more = step.where("on").select("comp", "id").join(sums, "comp").select("id", "leaves", "saved")
        added = more if added is None else added.unionByName(more)
        left = F.when(F.col("on"), F.col("w") - F.col("zw")).otherwise(F.col("w"))
        state = step.where("id <> z").select(*ids, left.alias("w"), F.when(F.col("below"), F.col("branch")).otherwise(F.col("comp")).alias("comp"))
    found = small.repartition("comp").sortWithinPartitions("comp", "depth").select("comp", "id", "parent", "leaves", "saved").mapInArrow(_in_task, "id long, leaves long, saved long")
    return (found if added is None else found.unionByName(added)).groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _digests(batches):
    """(k1, k2, bucket, text) in order -> the hash of each key's joined texts; a key's text may span batches and is never held whole."""
    key, digest, out = None, None, []

    def batch(rows):
        k1, k2, hexes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hexes, pa.string())], names=["k1", "k2", "ends"])

    for part in batches:
        for a, b, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if len(out) > 10_000:
            yield batch(out)
            out = []
    if key is not None:
        out.append((*key, digest.hexdigest()))
    if out:
        yield batch(out)


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, **columns: str) -> DataFrame:
    """-> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations, **columns)
    mine = Window.partitionBy("c").orderBy("d")
    upto = mine.rowsBetween(Window.unboundedPreceding, 0)
    keys = {f"k{i}": F.bit_xor(F.xxhash64(F.lit(i), F.col("d"), F.col("h1"), F.col("h2"))).over(upto) for i in (1, 2)}
    zero = F.lit(0).cast("long")
    steps = turns.withColumns(keys).withColumns({f"p{i}": F.coalesce(F.lag(f"k{i}").over(mine), zero) for i in (1, 2)})
    steps = staged(steps.join(convs, "c").select("c", F.col("d").cast("long").alias("d"), "k1", "k2", "p1", "p2", "words", (F.col("total") - F.col("d") + 1).cast("long").alias("rest")))

    made = steps.groupBy("k1", "k2").agg(F.min("c").alias("conv"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.sum("rest").alias("weight"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    top = convs.agg(zero.alias("k1"), zero.alias("k2"), F.min("c").alias("conv"), zero.alias("depth"), F.count("*").alias("n_convs"), zero.alias("words"), F.coalesce(F.sum(F.col("total") + 1), zero).cast("long").alias("weight"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    # numbered once, in a written table; the root is 0
    numbered = staged(made.withColumn("id", F.monotonically_increasing_id() + 1).unionByName(top.withColumn("id", zero)))
    up = numbered.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    children = numbered.where("id <> 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = staged(numbered.join(up, ["p1", "p2"], "left").join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero)))

    own = nodes.select("id", "parent", "conv", "depth", "weight", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.when(F.col("id") == 0, 0).otherwise((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved"))
    number = nodes.select("k1", "k2", "id", "parent")
    starts = nodes.select(F.col("conv").alias("c"), zero.alias("d"), "id", "parent").where("id = 0")
    stand_for = nodes.select(F.col("conv").alias("c")).distinct()
    walked = steps.select("c", "d", "k1", "k2").join(stand_for, "c", "left_semi").join(number, ["k1", "k2"]).select("c", "d", "id", "parent")
    # every path begins at the root
    roots = stand_for.where("c is not null").join(F.broadcast(starts.select("d", "id", "parent")))
    large = nodes.count() > limit
    paths = staged(walked.unionByName(roots.select("c", "d", "id", "parent"))) if large else walked
    sums = rollup(own, paths, limit)

    last = steps.where("rest = 1").select("c", "k1", "k2").unionByName(convs.where("total = 0").select("c", zero.alias("k1"), zero.alias("k2")))
    texts = last.groupBy("k1", "k2", F.shiftright("c", ID_BITS).alias("bucket")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("text"))
    ends = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "bucket").select("k1", "k2", "text").mapInArrow(_digests, "k1 long, k2 long, ends string")
    out = nodes.join(sums, "id").join(ends, ["k1", "k2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS root,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda u, w: CASE WHEN u % 2 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM t),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, role, text FROM (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.root AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h) q),
p AS (SELECT conv_id, d, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM b
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
e AS (SELECT conv_id, max(d) AS d FROM p GROUP BY 1),
n AS (SELECT k, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(words) AS words FROM p GROUP BY k),
m AS (SELECT n.*, CASE WHEN depth > 0 THEN k[1:depth - 1] END AS up FROM n),
h AS (SELECT up AS k, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY 1),
o AS (SELECT m.k, m.conv_id, m.depth, m.n_convs, m.up, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM m LEFT JOIN h USING (k)),
s AS (SELECT p.k, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(o.saved) AS saved_tokens FROM o JOIN p ON p.conv_id = o.conv_id AND p.d <= o.depth GROUP BY 1),
z AS (SELECT p.k, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN e USING (conv_id, d) GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(z.ends, sha256('')) AS ends_sha256
FROM o JOIN s USING (k) LEFT JOIN z USING (k) LEFT JOIN n q ON q.k = o.up"""
