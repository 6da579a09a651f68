"""Operators 12 and 13 against direct computation on small tables with nulls, ties and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from kumihimo.llm import divergence, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- 12


def audited(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ws in mine for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)
        groups = defaultdict(Counter)
        for _, source, ws in mine:
            groups[source].update(w for w in ws if df[w] >= least)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def test_divergence(spark):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefgÉß日" for b in ("", "x", "Y", "ü", "zz")]
    rows = []
    for k in range(400):
        lang, source = r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "s3", "É", None, ""])
        weight = [1 + (zlib.crc32(f"{w}{source}".encode()) % 9) ** 2 for w in vocabulary]
        rows.append((lang, source, " 1".join(r.choices(vocabulary, weight, k=r.randrange(30)))))
    rows += [("fr", "s1", "rare words only"), ("fr", "s2", None), ("xx", "s9", None), (None, "empty", ""), ("de", "long", "a " * 20_000), *rows[:20]]
    df = spark.createDataFrame([(*x, 1, "own", "own") for x in rows], "lang string, source string, text string, n long, term string, chunk string")
    for chunk, held in ((8192, 1_000_000), (3, 20)):
        got = divergence.audit(df, chunk=chunk, held=held).collect()
        assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == audited(rows, 10, 10)
    assert divergence.audit(df.limit(0)).count() == 0


def test_run_pieces_add_up_to_every_term():
    r = np.random.default_rng(5)
    for _ in range(20):
        size = int(r.integers(1, 200))
        weight = np.append(0, np.cumsum(r.integers(1, 5, size)))
        columns = []
        for _ in range(2):
            at = np.flatnonzero(r.random(size) < 0.4)
            columns.append((at, r.integers(1, 4, len(at))))
        lists, full = [], []
        for at, counts in columns:
            starts, values = divergence.runs(size, at, counts)
            lists.append((starts, divergence.shares(values, int(counts.sum()), size)))
            column = np.zeros(size, np.int64)
            column[at] = counts
            full.append(np.repeat(divergence.shares(column, int(counts.sum()), size), np.diff(weight)).astype(object))
        assert divergence.between(*lists, weight) == sum((p - q) ** 2 // (p + q) for p, q in zip(*full, strict=True))


def test_shares_of_counts_beyond_64_bits():
    n = 10**15
    assert divergence.shares(np.array([n // 3, 0]), n, 7).tolist() == [1 + 10**9 * (n // 3 + 2) // (n + 14), 1 + 2 * 10**9 // (n + 14)]


# ---- 13


def trie_rows(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts, key=lambda x: x[0])] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in cs if full[c] == k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, depth long")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_prefix_trie(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(60), 1000, 1003, 10**12 + 7]:
        for t in range(r.choice([1, 2, 3, 6])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["yes", "no  way", None, "tell me \n more"]) if t else "hello there you"))
    rows += [(70, t, "user", "say") for t in range(90)]  # a path
    rows += [(c, 0, "user", f"alone {c}") for c in range(100, 160)]  # a star
    rows += [(None, 0, "user", "of nobody"), (61, None, "user", "null first"), (61, 3, "user", "x " * 9000), (62, 0, "", ""), (62, 1, None, None)]
    want = sorted(trie_rows(rows), key=key)
    for limit in (4096, 7):
        got = [tuple(x) for x in trie.prefix_trie(conversations(spark, rows), limit=limit).collect()]
        assert sorted(got, key=key) == want


def test_prefix_trie_of_nothing(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(x) for x in trie.prefix_trie(conversations(spark, [])).collect()] == [(None, 0, None, 0, 0, 1, 0, empty)]


def test_prefix_trie_of_repeated_and_tied_turns(spark):
    """Equal rows are turns of their own; turns of one number have one order, whatever order they come in."""
    rows = [(40, 0, "user", "a"), (40, 0, "user", "a"), (40, 1, "user", "b"), (40, 1, "x", "c")]
    got = [sorted((tuple(x) for x in trie.prefix_trie(conversations(spark, p)).collect()), key=key) for p in (rows, rows[::-1])]
    assert got[0] == got[1] and [x[1] for x in sorted(got[0], key=lambda x: x[1])] == [0, 1, 2, 3, 4]


def test_centroid_sums_of_random_trees():
    r = random.Random(3)
    for n in (1, 2, 3, 10, 200):
        for shape in (lambda i: i - 1, lambda i: 0, lambda i: r.randrange(i)):
            parents = [-1, *(shape(i) for i in range(1, n))]
            depth = [0] * n
            for i in range(1, n):
                depth[i] = depth[parents[i]] + 1
            order = sorted(range(n), key=depth.__getitem__)
            place = {v: i for i, v in enumerate(order)}
            above = [-1 if parents[v] < 0 else place[parents[v]] for v in order]
            values = [(r.randrange(9), r.randrange(99)) for _ in range(n)]
            want = [list(v) for v in values]
            for i, _ in itertools.zip_longest(range(n - 1, 0, -1), ()):
                want[above[i]][0] += want[i][0]
                want[above[i]][1] += want[i][1]
            assert trie._parts(above, values) == want
