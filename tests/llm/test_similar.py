"""Links and components of near duplicates (operators 4 and 11) against brute force: bridges, large groups, odd rows."""

import itertools
import random
import re

import numpy as np
import pytest

from kumihimo.llm import jaccard_join, minhash

from .test_operators import ODD, brute_links, classes_of, docs, varied, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    """(n_shingles, component_id) of each row of different ids, by 3-word sets and 100 * both >= 85 * union."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(3, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in df.collect()}


def chain(n, size, step, seed):
    """Texts of which each has ``step`` words of its predecessor changed for good: neighbours are near, ends are not."""
    w = words(size, seed).split()
    out = []
    for k in range(n):
        out.append(" ".join(w))
        for j in range(step):
            w[(k * step + j) * 7 % size] = words(1, seed * 1000 + k * step + j + 0.5)
    return out


def bridged(n, seed, size=400):
    """Two groups of n near copies whose bases are far, and a path of two texts between the bases."""
    r = random.Random(seed)
    path, part = [words(size, seed).split()], size * 6 // 100
    for k in range(3):
        b = list(path[-1])
        b[2 * k * part : (2 * k + 1) * part] = words(part, seed + k + 0.25).split()
        path.append(b)
    out = [" ".join(w) for w in path]
    for base in (path[0], path[3]):
        for _ in range(n):
            w = list(base)
            w[r.randrange(size)] = words(1, r.random())
            out.append(" ".join(w))
    return out


def test_components_of_large_groups(spark):
    """Chains, groups and bridges through whole comparison, representatives and parts: no class is torn or joined."""
    rows = list(enumerate([*varied(60, 120, 9, 1), *chain(40, 140, 2, 3), *bridged(40, 5, 200), *(words(40, 7) + " " + words(40, 300 + k) for k in range(40))]))
    want = brute_components(rows)
    assert found(minhash.near_duplicates(docs(spark, rows), leaf=4, work=2_000, held=4_000)) == want


def test_jaccard_join_of_bridges_and_chains(spark):
    rows = list(enumerate([*varied(60, 120, 12, 1), *chain(40, 140, 2, 3), *bridged(40, 5, 200), *(words(40, 7) + " " + words(40, 300 + k) for k in range(40))]))
    want = brute_links(rows)
    assert classes_of(jaccard_join.near_duplicates(docs(spark, rows), leaf=4, work=2_000, held=4_000)) == want


def test_a_bridge_between_two_groups_of_thousands(spark):
    """At the default parameters. The sets of each group are all linked to its base; the bases meet over two texts."""
    rows = list(enumerate(bridged(2_500, 11)))
    shared = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows[:4]]
    alike = [len(x & y) / len(x | y) for x, y in ((shared[0], shared[1]), (shared[1], shared[2]), (shared[2], shared[3]), (shared[0], shared[3]))]
    assert min(alike[:3]) >= 0.85 and alike[3] < 0.7
    got = classes_of(jaccard_join.near_duplicates(docs(spark, rows)))
    assert {x[2] for x in got.values()} == {0}
    assert got[1][1] > 2_000 and got[2][1] > 2_000  # n_links of the bridge: its own neighbours, all of them


def test_minhash_cases(spark):
    a, b = words(60, 1), words(60, 2)
    rows = [(5, a), (3, a.upper()), (9, a + " x"), (None, a), (7, b), (7, a), (20, "one two"), (21, "ONE  two\n"), (22, "one two three"), (23, "É Ä"), (24, "é ä"), *ODD]
    got = sorted((tuple(x) for x in minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    n = 58
    want = [(5, n, 3, False), (3, n, 3, True), (9, n + 1, 3, False), (None, n, 3, False), (7, n, 7, True), (7, n, 3, False), (20, 1, 20, True), (21, 1, 20, False), (22, 1, 22, True), (23, 1, 23, True), (24, 1, 24, True), (900, 0, 900, True), (901, 0, 901, True), (902, 0, 902, True), (903, 1, 903, True), (904, 1, 904, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    alone = minhash.near_duplicates(docs(spark, [(None, "a b c"), (None, "d")])).collect()
    assert all(x["component_id"] is None and x["kept"] for x in alone)


def test_signatures_are_the_least_and_greatest_hashes():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 50)]
    flips, factors = minhash._functions(minhash.PERMUTATIONS)
    for s, got in zip(sets, minhash.signatures(sets), strict=True):
        for p in range(minhash.PERMUTATIONS):
            h = (s ^ flips[p]) * factors[p]
            assert got[2 * p] == h.min() and got[2 * p + 1] == h.max()


@pytest.mark.parametrize("n", [7, 20, 60, 400])
def test_signature_share_is_unbiased_and_cut_keeps_the_threshold(n):
    r = np.random.default_rng(n)
    apart = n * 15 // 100
    shares = []
    for _ in range(200):
        s = r.integers(0, 2**63, n).astype(np.uint64)
        a, b = minhash.signatures([s, s[apart:]])
        shares.append((a == b).mean())
        assert (a == b).sum() >= minhash.cut(minhash.THRESHOLD)
    want = 1 - apart / n
    spread = np.sqrt(want * (1 - want) / (2 * minhash.PERMUTATIONS))
    assert abs(np.mean(shares) - want) < 4 * spread / np.sqrt(200) + 1e-9
    assert np.std(shares) <= 1.15 * spread + 1e-9
