"""Each operator against brute force, an exact round trip or known labels, on small tables with nulls, ties and odd rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql.functions import lit

from kumihimo.llm import chat, decontaminate, html_extract, jaccard_join, line_dedup, pieces, pii, quality, token_counts, toxicity
from kumihimo.llm.components import components

DOCS = "doc_id long, text string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (id, text) with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(6)) for _ in range(n))


ODD = [(900, None), (901, ""), (902, "  \n "), (903, "one"), (904, "x " * 9000)]


# ---- 1


def test_html_cases():
    model = html_extract.train([])
    page = (
        "<html><head><title>t</title><script>var a='<p>'</script></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class='cookie notice'><p>We use cookies here.</p></div>"
        "<article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text that goes on for a while.<p>Second one, unclosed &lt;here&gt;.<div class='ad'>Buy this now</div></article>"
        "<div class='comments'><p>Nice article, I liked it very much.</p></div><footer>&copy; 2020</footer></body></html>"
    )
    assert html_extract.extract(model, [page, "", "<", "plain  text", "<script>x</script>"]) == ["A & B\nFirst bold text that goes on for a while.\nSecond one, unclosed <here>.", "", "<", "plain text", ""]


def test_html_marginals_are_exact():
    t = html_extract.parse("<div class=a><p>x<p>y<ul><li>z</ul></div>")
    f = html_extract.Forest([t])
    r = np.random.default_rng(1)
    unary, joint = r.normal(size=len(t.parent)), r.normal(size=(4, 2, 2))
    got, pairs = f.marginals(unary, joint, pairs=True)
    total, want = 0.0, np.zeros(len(unary))
    for y in itertools.product((0, 1), repeat=len(unary)):
        w = np.exp(sum(u * v for u, v in zip(unary, y)) + sum(joint[f.kind[k], y[p], y[k]] for k, p in enumerate(t.parent) if p >= 0))
        total += w
        want += w * np.array(y)
    assert np.allclose(got, want / total) and np.isclose(pairs.sum(), len(unary) - 1)


def test_html_query_rows(spark):
    rows = [(1, "u", "<article><p>Some text of the page goes here, and on.</p></article>"), (2, None, None), (1, "u", "<article><p>Some text of the page goes here, and on.</p></article>"), (None, "v", "")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, rows[0][2][12:-14], 40), (1, rows[0][2][12:-14], 40), (2, "", 0)]
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("source", ["<a " * 350_000, '<a ">' * 200_000, "<center>" * 60_000 + "<p>x" * 30_000, "<!-- " * 200_000, "<script>" + "</script " * 100_000, "<div>" * 150_000 + "x", "<" * 1_000_000, "a &amp; " * 130_000, "<a b='" + '<a "' * 200_001 + ">", "<p a=\"'\">" * 90_000 + "'", "<p " + "a='>' " * 200_000 + ">x"])
def test_html_of_a_megabyte_is_read_in_one_go(source):
    began = time.process_time()
    t = html_extract.parse(source)
    assert time.process_time() - began < 20 and max(t.depth) <= html_extract._DEEPEST + 1


@pytest.mark.parametrize("size", [1_000, 20_000, 1_000_000])
def test_html_long_values_stay_in_their_tag(size):
    model, data = html_extract.train([]), "data:image/png;base64," + "A9+/" * (size // 4)
    page = f'<article><p>Some text of the page goes here, before.</p><img alt="a > b" src="{data}"><p title=\'{data}>\'>More of the text comes after it, and ends.</p></article>'
    assert html_extract.extract(model, [page]) == ["Some text of the page goes here, before.\nMore of the text comes after it, and ends."]
    assert html_extract.extract(model, [page.replace('">', ">", 1) + "</html>"])[0].startswith("Some text of the page goes here, before.")


def test_html_pages_that_do_not_name_their_article():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    model = html_extract.train([p for p in pages if p and "<article" in p])
    named = html_extract.extract(model, pages)
    plain = [re.sub(r"</article>", "</div>", re.sub(r"<article\b[^>]*>", "<div>", p)) for p in pages]
    assert html_extract.extract(model, plain) == named and sum(map(bool, named)) > 10
    long_names = pages[0].replace("<article", '<article class="' + "x-a y-b " * 30 + '"', 1)
    assert html_extract.extract(model, [long_names]) == named[:1]


def test_html_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some text of the page goes here.</p></article>", "x", 5)], "page_id long, url string, html string, text string, key long")
    assert [tuple(r) for r in html_extract.main_text(df).collect()] == [(1, "u", "Some text of the page goes here.", 32)]


# ---- 2


def counts(text):
    ws = WORD.findall(text or "")
    c = Counter(zip(ws, ws[1:], ws[2:]))
    rep = {j for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(3)
    good = [(i, "\n".join(words(40, 100 * i + k) + "." for k in range(4))) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in words(90, i).split())) for i in range(5)] + [(200 + i, words(90, i).upper().replace(" ", "!! ")) for i in range(5)]
    mixed = [(300 + i, " ".join(r.choice("ab") for _ in range(40)) + "\n" + "é x") for i in range(5)]
    rows = good + junk + mixed + ODD + [(5, good[5][1])]
    got = quality.score(quality.features(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for row in got:
        n = counts(text[row["doc_id"]])
        assert tuple(row[c] for c in quality.BASE) == n
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        if row["doc_id"] < 100:
            assert row["kept"]
        if 100 <= row["doc_id"]:
            assert not row["kept"]
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_quality_capitals_are_counted_in_any_text(spark):
    got = quality.features(docs(spark, [(1, "ABC DEF İ"), (2, "ABC DEF I")])).collect()
    assert [r["n_upper"] for r in got] == [7, 7]


def test_quality_em_against_a_direct_one():
    """The fit from vote patterns and counts equals one over all rows, written out; its posterior is Bayes' rule."""
    r = np.random.default_rng(4)
    truth = r.random(3000) < 0.8
    votes = np.where(r.random((3000, 5)) < 0.3, 0, np.where(r.random((3000, 5)) < [0.95, 0.9, 0.85, 0.8, 0.55], 1, -1) * np.where(truth, 1, -1)[:, None])
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, logs = quality.fit(patterns, counts.astype(float))
    good = np.where((votes == -1).any(1), 0.1, 0.9)
    pseudo = {0: [4.0, 1.0, 2.0], 1: [0.2, 1.0, 8.0]}
    for _ in range(200):
        table = {(c, j): [pseudo[c][v] + weight[votes[:, j] + 1 == v].sum() for v in range(3)] for c, weight in ((0, 1 - good), (1, good)) for j in range(5)}
        p = (good.sum() + 9) / (3000 + 10)
        like = [np.prod([np.array(table[c, j])[votes[:, j] + 1] / sum(table[c, j]) for j in range(5)], axis=0) for c in (0, 1)]
        new = p * like[1] / (p * like[1] + (1 - p) * like[0])
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    assert abs(share - p) < 1e-6
    assert all(np.allclose(np.exp(logs[c, j]), np.array(table[c, j]) / sum(table[c, j]), atol=1e-5) for c in (0, 1) for j in range(5))
    accuracy = np.exp(logs[1, :, 2]) / (np.exp(logs[1, :, 0]) + np.exp(logs[1, :, 2]))
    assert (np.argsort(accuracy)[0] == 4) and ((good > 0.5) == truth).mean() > 0.93


def test_quality_stage_with_null_and_shared_ids(spark):
    good = "\n".join(words(40, k) + "." for k in range(4))
    junk = " ".join(w + "###" for w in words(90, 5).split()).upper()
    rows = [(i, "\n".join(words(40, 100 * i + k) + "." for k in range(4))) for i in range(40)] + [(None, good), (None, junk), (3, junk), (None, None)]
    kept = quality.keep_good(docs(spark, rows).withColumn("row", lit(1)).withColumn("kept", lit("x")))
    assert kept.columns == ["doc_id", "text", "source", "n_chars", "row", "kept"]
    assert sorted([x["text"] for x in kept.collect()]) == sorted([t for _, t in rows[:41]])


# ---- 3


def test_line_dedup(spark):
    block = [words(20, 1), "", words(20, 2), words(20, 3)]
    short = [words(20, 9)]
    own = lambda k: [words(12, 50 + k) for _ in range(1)]
    rows = [
        (1, "\n".join(own(1) + block + own(2))),
        (2, "\n".join(block + own(3))),
        (3, "\n".join(own(4) + block[2:] + own(5) + block[:1] + short)),  # 40 words in a row only: stays
        (4, "\n".join(own(6) + short)),
        (5, "\n".join(own(1) + block + own(2))),  # an exact copy
        (6, "\n".join([words(60, 7), words(60, 8)])),
        (7, "\n".join([words(60, 8), own(8)[0], words(60, 7)])),  # moved blocks
        *ODD,
    ]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[6]["text"] == rows[5][1]
    assert got[2]["text"] == own(3)[0]
    assert got[3]["text"] == rows[2][1] and got[4]["text"] == rows[3][1]
    assert got[5]["text"] == "" and got[5]["n_kept"] == 0
    assert got[7]["text"] == own(8)[0]
    assert got[900]["text"] is None and got[901]["text"] == "" and got[904]["text"] == ODD[4][1]
    assert {r["doc_id"] for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()} == {1, 2, 3, 4, 6, 7, 900, 901, 902, 903, 904}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def brute_gone(texts, least):
    """For each text of a list the lines in any common block of so many words with any text before it."""
    out = []
    for k, text in enumerate(texts):
        a = [x.strip() for x in text.split("\n")]
        gone = set()
        for other in texts[:k]:
            b = [x.strip() for x in other.split("\n")]
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in a[i : i + n]) >= least:
                        gone.update(range(i, i + n))
        out.append(gone)
    return out


def test_all_common_blocks_go(spark):
    r = random.Random(8)
    lines = ["a", "b b", "c c c", "", "d d d d", " e", "f f f f f f"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 14))) for _ in range(60)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs(spark, list(enumerate(texts))), min_words=7).collect()}
    for k, gone in enumerate(brute_gone(texts, 7)):
        kept = [x for i, x in enumerate(texts[k].split("\n")) if i not in gone]
        assert (got[k]["text"], got[k]["n_kept"]) == ("\n".join(kept), len(kept))
        assert 0 <= got[k]["n_moved"] <= len(gone)
    assert any(x["n_moved"] for x in got.values())


def test_patience_chain():
    r = random.Random(3)
    for _ in range(200):
        pairs = [(i, r.randint(0, 9)) for i in range(r.randint(0, 9))]
        chain = [p for p, kept in zip(pairs, line_dedup.increasing(pairs)) if kept]
        assert all(x[1] < y[1] for x, y in zip(chain, chain[1:]))
        longest = max((n for n in range(len(pairs) + 1) if any(all(x[1] < y[1] for x, y in zip(s, s[1:])) for s in itertools.combinations(pairs, n))), default=0)
        assert len(chain) == longest


def test_line_dedup_of_null_and_shared_ids_and_long_texts(spark):
    block, tail = words(60, 1), words(70, 2)
    long = "\n" * 100_000 + block + "\n" * 100_000 + "\n".join(["x y z"] * 50_000)
    rows = [(5, block + "\nown"), (5, "\n" + block), (None, block + "\n" + tail), (None, tail), (9, long), (10, long + "\nmore")]
    assert line_dedup.dedup_lines(docs(spark, rows)).columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_kept", "n_moved"]
    got = [(x["doc_id"], x["n_kept"], x["n_lines"]) for x in line_dedup.dedup_lines(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert sum(n for i, n, _ in got if i == 5) in (2 + 1, 1 + 2)  # one of the two keeps the block
    assert sorted(n for i, n, _ in got if i is None) in ([0, 1], [1, 1])
    assert dict((i, n) for i, n, _ in got if i and i > 8) == {9: 249_998, 10: 1}  # a blank line and the block are in 5 too
    clash = docs(spark, rows).withColumn("n_lines", lit("own")).withColumn("row", lit(1)).withColumn("first", lit(2))
    assert set(line_dedup.dedup_lines(clash).columns) == {*clash.columns, "n_kept", "n_moved"}
    kept = line_dedup.drop_repeated_lines(clash)
    assert kept.columns == clash.columns and {x["n_lines"] for x in kept.collect()} == {"own"}


# ---- 4


def brute_links(rows, k=5, at=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        n = min(k, len(w))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else None
    rep = {}
    for i in sorted(sets):
        if sets[i] is not None:
            rep.setdefault(sets[i], i)
    links, parent = Counter(), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(rep.values()), 2):
        x, y = sets[a], sets[b]
        if len(x & y) / len(x | y) >= at:
            links[a] += 1
            links[b] += 1
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    return {i: (i, 0, i) if s is None else (rep[s], links[rep[s]], find(rep[s])) for i, s in sets.items()}


def classes_of(df):
    return {x["doc_id"]: (x["rep_id"], x["n_links"], x["class_id"]) for x in df.collect()}


def test_jaccard_join(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = words(60 + 5 * g, g).split()
        for v in range(1 + g * (2 if g == 11 else 1)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = words(1, r.random())
            rows.append((len(rows), " ".join(w)))
    rows += [(500, rows[3][1]), (501, "a b"), (502, "a b"), (503, "a b c"), *ODD]
    got = classes_of(jaccard_join.near_duplicates(docs(spark, rows)))
    assert got == brute_links(rows)
    kept = {x["doc_id"] for x in jaccard_join.keep_one(docs(spark, rows + rows[:2])).collect()}
    assert kept == {c for _, _, c in got.values()}


def varied(n, size, most, seed):
    """A text and n variants with up to ``most`` words changed: the base is near to those with few changes, which hardly are near to each other."""
    r = random.Random(seed)
    base = words(size, seed).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(size)] = words(1, r.random())
        out.append(" ".join(w))
    return out


def test_jaccard_join_of_large_groups(spark):
    """Buckets and clusters that representatives and splits have to take apart: no class is torn or joined."""
    rows = list(enumerate([*varied(90, 120, 12, 1), *varied(30, 90, 2, 2), *(words(40, 7) + " " + words(40, 300 + k) for k in range(40))]))
    assert classes_of(jaccard_join.near_duplicates(docs(spark, rows), leaf=8, work=8_000)) == brute_links(rows)


def test_jaccard_join_tells_rows_with_null_or_shared_ids_apart(spark):
    a, b = ((words(80, k), words(79, k) + " other") for k in (4, 9))
    rows = [(None, a[0]), (7, a[1]), (7, b[0]), (None, b[1]), (None, None), (None, "solo text here"), (8, a[0]), (8, a[0])]
    got = [tuple(x) for x in jaccard_join.near_duplicates(docs(spark, rows)).select("doc_id", "n_copies", "n_links", "class_id").collect()]
    want = [(None, 3, 1, 7), (7, 1, 1, 7), (7, 1, 1, 7), (None, 1, 1, 7), (None, 1, 0, None), (None, 1, 0, None), (8, 3, 1, 7), (8, 3, 1, 7)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [x["text"] for x in jaccard_join.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([a[1], b[0], None, "solo text here"], key=str)


def test_jaccard_join_of_short_texts(spark):
    rows = []
    for g in range(240):
        n = (14, 24, 34, 49)[g % 4]  # 10, 20, 30 and 45 shingles, of which a fifth at most goes
        w = words(n, 2000 + g).split()
        cut = n - (n - 4) // 5
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:cut]))]
    got = classes_of(jaccard_join.near_duplicates(docs(spark, rows)))
    assert got == brute_links(rows) and all(n == 1 for _, n, _ in got.values())


def test_sketch_cuts_keep_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    for n in (5, 10, 20, 50, 100, 400):
        cut = jaccard_join._cuts(0.8)[2 * n - n // 5]  # a set of n and one without a fifth of it
        for _ in range(300):
            tokens = r.integers(0, 2**63, n).astype(np.uint64)
            a, b = (np.frombuffer(jaccard_join.sketch(t), np.uint8) for t in (tokens, tokens[n // 5 :]))
            assert (a == b).sum() >= cut


def test_jaccard_of_empty_table(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 1)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 200: 200, 201: 200}


# ---- 5


def test_escapes():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["<", "s", ">", "/", "\\", "[", "INST", "]", "</s>", "[INST]", "<<SYS>>", "\n", "x", "&"]) for _ in range(r.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        assert chat.parse(f"<s>user\n{e}</s><s>assistant\nq</s>") == [("user", t), ("assistant", "q")]


def test_chat_round_trip(spark):
    r = random.Random(2)
    rows = []
    for conv in range(12):
        n = r.randint(1, 14)
        rows += [(conv, k, "system" if k == 0 and conv % 2 else ("user", "assistant")[k % 2], words(r.randint(0, 90), conv * 50 + k)) for k in range(n)]
    rows += [(50, 0, None, None), (50, 1, "assistant", "</s>[INST] é ok"), (51, 0, "odd\nrole&#10;", "x"), (None, 3, "assistant", words(600, 4)), (52, 0, "user", "a"), (52, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_chat(df, budget=200, history=60)
    got = {x["conv_id"]: x for x in chat.read_back(windows).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        assert w["n_tokens"] <= 200 or w["n_turns"] - w["n_repeated"] == 1
    assert any(w["n_repeated"] > 0 for w in windows.collect())
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_long_white_space_is_encoded_like_short(monkeypatch):
    coder = chat.encoder(chat.VOCABULARY)
    texts = [a + w * n + b for w in (" ", "\n", "\t ", " \n", "\u3000") for n in (11, 29) for a in ("", "pre") for b in ("", "x", "1", "!x", "é")]
    want = [coder.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(chat, "_SPACES", re.compile(chat._SPACES.pattern.replace("10000", "10")))
    monkeypatch.setattr(chat, "_RUN", 10)
    assert [chat.encode(coder, t) for t in texts] == want


def test_chat_and_tokens_of_a_megabyte(spark):
    texts = [" " * 1_000_000, "a" + "\n \t" * 340_000 + "b", "x" * 1_000_000]
    df = spark.createDataFrame([(k, 0, "assistant", t, 1) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string, window long")
    got = {x["conv_id"]: x["loss_sha256"] for x in chat.read_back(chat.format_chat(df)).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}
    counted = token_counts.section_tokens(docs(spark, list(enumerate(texts)))).groupBy("doc_id").sum("n_tokens").collect()
    coder = chat.encoder(chat.VOCABULARY)
    assert {x[0]: x[1] for x in counted} == {k: len(chat.encode(coder, t)) for k, t in enumerate(texts)}


# ---- 6


def brute_hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w = cut(t)
        hit, names = set(), set()
        for name, text in items:
            v = cut(text)
            n = min(10, len(v))
            runs = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1) if runs else ():
                if tuple(w[s : s + n]) in runs:
                    hit.update(range(s, s + n))
                    names.add(str(name))
        joined = ",".join(sorted(names))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark):
    items = [(10, words(30, 1)), (2, "alpha beta gamma"), (3, "Ünder solo"), (4, None), (5, "!!"), (6, words(10, 6)), (10, words(12, 8)), (7, "zz")]
    rows = [
        (1, "pre " + words(30, 1).upper() + " post"),
        (2, "x " + " ".join(words(30, 1).split()[5:15]) + " y"),
        (3, "x " + " ".join(words(30, 1).split()[5:14]) + " y"),
        (4, "alpha, Beta-gamma alpha beta"),
        (5, "Ünder solo ünder solo"),
        (6, words(10, 6) + " " + words(10, 6)),
        (7, " ".join(words(30, 1).split()[:12] + words(12, 8).split())),
        (8, "zz ZZ z"),
        (8, "zz ZZ z"),
        *ODD,
    ]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), df)
    assert sorted(tuple(r) for r in got.collect()) == brute_hits(rows, items)
    assert decontaminate.contaminated(docs(spark, []), df).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contaminated(docs(spark, rows), df.limit(0)).collect())
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), df).collect()} == {3, 900, 901, 902, 903, 904}


def test_decontamination_with_null_and_shared_ids(spark):
    items = spark.createDataFrame([(None, words(30, 1)), (2, words(12, 2))], "item_id long, text string")
    rows = [(None, words(30, 1)), (None, words(40, 7)), (4, words(12, 2)), (4, words(20, 8)), (5, "\n" * 300_000 + words(12, 2) + " x" * 60_000)]
    clash = docs(spark, rows).withColumn("row", lit(1)).withColumn("w", lit(2)).withColumn("n", lit(3)).withColumn("item_id", lit(4))
    got = sorted(((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.contaminated(clash, items).collect()), key=str)
    assert got == sorted([(None, 30, 1), (None, 0, 0), (4, 12, 1), (4, 0, 0), (5, 12, 1)], key=str)
    kept = decontaminate.drop_contaminated(clash, items)
    assert kept.columns == clash.columns and sorted(x["text"] for x in kept.collect()) == sorted([words(40, 7), words(20, 8)])


def test_decontamination_is_native(spark):
    df = spark.createDataFrame([(1, words(30, 1))], "item_id long, text string")
    plan = decontaminate.contaminated(docs(spark, [(1, words(40, 1))]), df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 7


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution(spark, rule):
    rows = [(1, "first line\n\nthird é line\n"), (2, "日本語\nテキスト🙂"), (3, "a" * 50 + "\n\n\n" + "b"), *ODD]
    coder = chat.encoder(chat.VOCABULARY)
    got = {}
    for r in token_counts.section_tokens(docs(spark, rows), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"]))
    for i, text in rows:
        text = text or ""
        lines = text.split("\n")
        sections = sorted(got[i])
        assert len(sections) == len(lines)
        assert abs(sum(s[3] for s in sections) - len(coder.encode_ordinary(text))) < 1e-6
        assert [text[s[1] : s[2]] for s in sections] == [x + "\n" for x in lines[:-1]] + [lines[-1]]
        if rule == "start":
            at, starts = 0, []
            for t in coder.encode_ordinary(text):
                starts.append(at)
                at += len(coder.decode_single_token_bytes(t))
            edges = np.cumsum([0] + [len(x.encode()) + 1 for x in lines])
            assert [s[3] for s in sections] == [sum(a <= s < b for s in starts) for a, b in zip(edges[:-1], edges[1:])]
        else:
            at, want = 0, [0.0] * len(lines)
            edges = np.cumsum([0] + [len(x.encode()) + 1 for x in lines])
            for t in coder.encode_ordinary(text):
                size = len(coder.decode_single_token_bytes(t))
                shares = [max(0, min(b, at + size) - max(a, at)) / size for a, b in zip(edges[:-1], edges[1:])]
                if rule == "split":
                    want = [x + y for x, y in zip(want, shares)]
                else:
                    want[shares.index(max(shares))] += 1
                at += size
            assert np.allclose([s[3] for s in sections], want)
    assert token_counts.section_tokens(docs(spark, [])).count() == 0
    twice = docs(spark, [(None, "a\nb"), (7, "c"), (7, "d e")]).withColumn("section", lit("x")).withColumn("start", lit(0))
    assert sorted((str(r["doc_id"]), r["section"]) for r in token_counts.section_tokens(twice, rule=rule).collect()) == [("7", 0), ("7", 0), ("None", 0), ("None", 1)]


# ---- 8


def test_base_patterns():
    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("a1.@- +_()23456") for _ in range(r.randint(0, 40)))
        want = [(0, *m.span()) for m in patterns[0].finditer(t)]
        want += [(1, *m.span()) for m in patterns[1].finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in patterns[2].finditer(t):
            d = re.sub("[ -]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                want.append((2, *m.span()))
        want += [(3, *m.span()) for m in patterns[3].finditer(t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert pii.base_spans(t) == want
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_crf_gradient():
    r = np.random.default_rng(0)
    e, move, y = r.normal(size=(4, 2, pii.TAGS)), r.normal(size=(pii.TAGS, pii.TAGS)), r.integers(0, pii.TAGS, (4, 2))
    loss, de, dm = pii._crf(move, e, y)
    for a, g in ((e, de), (move, dm)):
        k = tuple(r.integers(0, n) for n in a.shape)
        a[k] += 1e-5
        assert abs((pii._crf(move, e, y)[0] - loss) / 1e-5 - g[k]) < 1e-3
        a[k] -= 1e-5


def test_lstm_gradient():
    r = np.random.default_rng(1)
    m = pii.new_model(3)
    x, want = r.normal(size=(6, 2, pii.EMBED)).astype(np.float32), r.normal(size=(6, 2, pii.HIDDEN)).astype(np.float32)
    loss = lambda: float((pii._lstm(m, "f", x, True)[0] * want).sum())
    grad = {k: np.zeros_like(v) for k, v in m.items()}
    _, held = pii._lstm(m, "f", x, True)
    dx = pii._lstm_back(m, "f", x, held, want, grad)
    for a, g in ((m["w_f"], grad["w_f"]), (m["u_f"], grad["u_f"]), (m["b_f"], grad["b_f"]), (x, dx)):
        for _ in range(4):
            k = tuple(r.integers(0, n) for n in a.shape)
            old = a[k]
            a[k] = old + 1e-2
            up = loss()
            a[k] = old - 1e-2
            assert abs((up - loss()) / 2e-2 - g[k]) < 1e-2 * max(1, abs(g[k]))
            a[k] = old


def test_viterbi_and_marginals_against_all_paths():
    r = np.random.default_rng(2)
    e, move = r.normal(size=(5, pii.TAGS)), r.normal(size=(pii.TAGS, pii.TAGS))
    paths = list(itertools.product(range(pii.TAGS), repeat=5))
    score = np.array([sum(e[t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert tuple(pii.viterbi(move, e)) == paths[int(score.argmax())]
    weight = np.exp(score - score.max())
    want = np.zeros((5, pii.TAGS))
    for p, w in zip(paths, weight / weight.sum()):
        want[np.arange(5), p] += w
    assert np.allclose(pii.marginals(move, e), want)


@pytest.fixture(scope="module")
def pii_model():
    """Trained with a fifth of the shapes left out, in the words of a small table."""
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    held = [s for s in pii.SHAPES if zlib.crc32(repr(s).encode()) % 5 == 0]
    return pii.train(*pii.examples([x for t in texts for x in pii.snippets(t)], [s for s in pii.SHAPES if s not in held])), held, texts


def test_pii_model_finds_shapes_it_was_not_trained_on(pii_model):
    model, held, texts = pii_model
    r = np.random.default_rng(11)
    own = [w for t in texts for w in t.split() if w.isalpha()]
    hit = {k: [] for k in range(4)}
    for shape in held:
        for _ in range(12):
            w = [own[int(i)] for i in r.integers(0, len(own), 30)]
            span = pii.SHAPES[shape](r, own)
            text = " ".join(w[:14]) + " " + span + " " + " ".join(w[14:])
            a = len(" ".join(w[:14])) + 1
            base = pii.base_spans(text)
            found = [*base, *pii.model_spans(model, [text], [base])[0]]
            hit[shape[0]].append((shape[0], a, a + len(span)) in found)
    print({k: round(float(np.mean(v)), 2) for k, v in hit.items()})
    assert np.mean([x for v in hit.values() for x in v]) >= 0.8 and all(np.mean(v) >= 0.4 for v in hit.values())
    clean = [t for t in texts if not pii.base_spans(t)]
    added = pii.model_spans(model, clean, [[] for _ in clean])
    assert sum(map(bool, added)) <= len(clean) // 100


def test_pii_windows_are_reconciled_as_if_all_were_scored(pii_model, monkeypatch):
    model = pii_model[0]
    mails = ["anna [at] mail.example.com", "anna(at)mail.example.com", "anna (AT) mail.example.com", "anna at mail dot example dot com"]
    texts = [f"{words(n, n)} write to {mail} {words(40, n + 1)}" for n in (10, 60) for mail in mails]
    found = lambda: pii.model_spans(model, texts, [[] for _ in texts])
    got = found()
    assert sum([t[a:b] for _, a, b in s] == [m] for t, m, s in zip(texts, mails * 2, got)) >= 4
    monkeypatch.setattr(pii, "_CUE", re.compile("."))  # every window is scored
    assert found() == got
    # the emissions of one text, averaged by hand over its windows
    text = texts[-1]
    codes, starts = pii.classes(text), pii._starts(len(text)).tolist()
    total, mass = np.zeros((len(text), pii.TAGS)), np.zeros(len(text))
    for at in starts:
        row = np.full((1, pii.WINDOW), pii.CLASSES - 1)
        part = codes[at : at + pii.WINDOW]
        row[0, : len(part)] = part
        for i, e in enumerate(pii.emissions(model, row)[0][: len(part)]):
            w = 1 + min(i, pii.WINDOW - 1 - i)
            total[at + i] += w * e
            mass[at + i] += w
    tags = pii.viterbi(model["move"], total / mass[:, None])
    a, b = got[-1][0][1:] if got[-1] else (0, 0)
    assert set(tags[a:b].tolist()) <= {1}


def test_pii_query_rows(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        number = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        mail = f"{words(1, i)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com"
        ip = ".".join(str(r.randint(1, 250)) for _ in range(4))
        rows.append((i, f"{words(20, i)} {r.choice([number, mail, ip])} {words(20, i + 500)}"))
    clean = [(1000 + i, words(40, i + 900) + " version 4.0 of 2024") for i in range(20)]
    more = [(None, "mail x@y.org"), (3, "another text of 3, a@b.example"), (2000, words(9, 1) + "\n" * 900_000 + "9" * 30_000 + " 10.2.3.4 " + "x@" * 50_000)]
    every = rows + clean + ODD + more + [(3, rows[3][1])]
    got = pii.find_personal_data(docs(spark, every).withColumn("row", lit(1)).withColumn("spans", lit("x")).withColumn("made", lit(0)), count=400).collect()
    want = sorted((str(i), pii.show(pii.base_spans(t or ""))) for i, t in every)
    assert sorted((str(x["doc_id"]), ",".join(s for s in x["spans"].split(",") if s)) for x in got if x["n_added"] == 0) == [w for w in want if w in {(str(x["doc_id"]), x["spans"]) for x in got if x["n_added"] == 0}]
    texts = {}
    for i, t in every:
        base = pii.base_spans(t or "")
        texts.setdefault((i, hashlib.sha256(pii.show(base).encode()).hexdigest()), base)
    for x in got:
        base = texts[x["doc_id"], x["base_sha256"]]
        assert {s for s in pii.show(base).split(",") if s} <= set(x["spans"].split(","))
        assert x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"] == len(base) == x["n_spans"] - x["n_added"]
        if 900 <= (x["doc_id"] or 0) < 2000:
            assert x["spans"] == ""
    assert len(got) == len(every) and pii.find_personal_data(docs(spark, []), count=80).count() == 0


# ---- 9


def test_chain_marginals_are_exact():
    r = np.random.default_rng(0)
    lengths = np.array([1, 3, 4, 6, 2])
    flat, em, move = r.integers(0, 5, lengths.sum()), r.normal(size=5), r.normal(size=(2, 2))
    chains = toxicity.Chains(flat, lengths)
    p, pairs, log_z = chains.marginals(em[chains.words], move)
    want, all_pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        line = flat[at : at + n]
        at += n
        weight = {y: np.exp(sum(em[a] * b for a, b in zip(line, y)) + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        total += np.log(z)
        want += [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                all_pairs[a, b] += w / z
    assert np.allclose(p[chains.given], want) and np.allclose(pairs, all_pairs) and np.isclose(total, log_z)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(6)
    bad = ["vilewort", "scumbag", "dreckig"]
    rows, labels = [], []
    for i in range(300):
        w = words(60, i).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad) + r.choice(["", ",", "!!"])
        rows.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:])))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    known = spark.createDataFrame([*labels, (None, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs(spark, rows + ODD), known).collect()}
    assert len(got) == len(rows) + len(ODD)
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300))
    text = dict(rows)[0]
    spans = [text[int(s.split(":")[0]) : int(s.split(":")[1])] for s in got[0]["toxic_spans"].split(",")]
    assert spans and all(toxicity.bare(s) in bad for s in spans)
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] <= 1 for i, _ in ODD)
    assert toxicity.score_toxicity(docs(spark, []), known).count() == 0


def test_toxicity_pieces_are_from_the_whole_text():
    text = "\n".join(f"w{k} " * 40 for k in range(300)) + "\n" + "end " * 200
    assert sum(len(x.split()) for x in toxicity.pieces(text, 10**9)) == 12200
    some = toxicity.pieces(text, 1000)
    assert 900 <= sum(len(x.split()) for x in some) <= 1000
    at = [int(x.split()[0][1:]) for x in some if x.startswith("w")]
    assert at == sorted(at) and at[-1] > 200 and at[0] < 100
    assert toxicity.pieces("", 5) == toxicity.pieces(" \n ", 5) == []


def test_toxicity_late_in_a_long_text_with_null_and_shared_ids(spark):
    r = random.Random(6)
    rows = [(i, " ".join([*words(60, i).split(), *(["vilewort", "scumbag"] if i % 3 == 0 else [])])) for i in range(150)]
    late = words(200, 9) + "\n" * 200_000 + " vilewort scumbag vilewort"
    rows += [(None, late), (None, words(30, 1)), (5, "scumbag vilewort " + words(20, 3)), *ODD]
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows).withColumn("toxic", lit(0)).withColumn("lines", lit("x")).withColumn("row", lit(r.random())), known).collect()
    assert len(got) == len(rows)
    assert sorted(x["predicted"] for x in got if x["doc_id"] is None) == [0, 1] and sorted(x["predicted"] for x in got if x["doc_id"] == 5) == [0, 1]
    assert all(x["held_out"] is False for x in got if x["doc_id"] is None)


# ---- 10


def test_sampled_pieces():
    p = pieces.Pieces(sharpness=0.3)
    texts = ["", "  ", "▁a ▁", "a \U0010FFFF b", "\U0010FFFF" + "▁" * 60, "xy" * 3000, " " * 1000, "▁" * 49, "￾ x", "日本語🙂 <s></s><0x41>", "a" * 500, "   lead and   trail   ", "x" * 47 + " " + "y" * 48 + " " + "z▁" * 60, "\n\t\r"]
    for k in range(10):
        for t, ids in zip(texts, p.encode(texts, [k] * len(texts))):
            assert p.decode(ids.tolist()) == t
            assert ids.tolist() == p.encode([t], [k])[0].tolist()

    def every(into, j):
        return [((), 1.0)] if j == 0 else [(a + e[2], w * e[1]) for e in into[j] for a, w in every(into, e[0])]

    into = [[], *(p.ending(" the", j) for j in range(1, 5))]
    paths = every(into, len(into) - 1)
    total = sum(w for _, w in paths)
    got = Counter(tuple(x) for x in p.encode([" the"] * 20000, list(range(20000))))
    assert len(paths) > 3 and max(abs(got[a] / 20000 - w / total) for a, w in paths) < 0.02


def test_pieces_in_spark(spark):
    rows = [(1, "some text"), (1, "some text"), (None, "x y"), *ODD]
    out = pieces.decode(pieces.encode(docs(spark, rows)))
    assert set(out.columns) == {"doc_id", "text", "source", "n_chars", "ids", "decoded"}
    got = out.repartition(3).collect()
    assert len(got) == len(rows) and all(r["decoded"] == r["text"] for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 1
    assert pieces.encode(docs(spark, [])).count() == 0
