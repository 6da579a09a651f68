"""Operator 8: personal data by a character BiLSTM with CRF transitions, beside fixed patterns.

Fixed patterns give base spans of four kinds; they always stay. A model adds
spans that the patterns can't express (an address with a written-out at sign,
a phone number without its plus, a card number cut by dots): a bidirectional
LSTM over character classes scores five tags a character (none and the four
kinds), CRF transitions score their order, and both are trained together in
numpy by gradient descent on the exact CRF likelihood.

Labelled spans for training: the base spans of a bounded sample of snippets of
the table's texts, and spans generated in many shapes (:data:`SHAPES`) and put
into these snippets, beside numbers that are no personal data
(:data:`OTHERS`). So the model is trained alike on tables with many base spans,
few or none.

A text is read in windows of ``WINDOW`` characters, each half over the next.
Overlapping emissions are averaged, a character counting more the nearer it is
to a window's middle; one Viterbi pass over the reconciled emissions decodes
each stretch as a whole, and forward-backward marginals over the same
emissions decide: a decoded span stays if its characters' mean marginal is
``ACCEPT`` or more, it begins and ends at a word's edge and touches no base
span; a card number has to pass Luhn's test besides, which no model of
characters can learn. Every shape holds a digit, an at sign or a written-out at with a
separator (:data:`_CUE`); windows within ``REACH`` characters of one are
scored, and texts are decoded there.

The fit uses snippets of at most ``sample`` texts with a base span and as many
others, those with the least hash of id and text, at most SNIPPETS of each,
chosen anywhere in the text, and ``count`` training windows.

Defined cases: null and empty texts have no spans; repeated rows each count;
without any text the generated spans are trained in made-up words; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import keyed, map_text, slices, spread, staged, table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
SAMPLE = 400
SNIPPETS = 4
EXAMPLES = 6000
REACH = 64
ACCEPT = 0.8
EPOCHS = 8
EMBED, HIDDEN, TAGS = 12, 20, 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried once, from its first digit, and never given back: leftmost matches begin nowhere else
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: What every shape of a span holds at least one of.
_CUE = re.compile(r"[0-9@]|[\[({<_]\s?at\s?[\])}>_]|\bat\b(?=[^\n]{1,40}\bdot\b)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: the local part reaches back over its run, but not into the match before."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---- the model

_CLASS = np.zeros(129, np.int64)  # of a code point; 128 stands for all beyond ASCII
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
for _i in range(10):
    _CLASS[48 + _i] = 27
for _i, _c in enumerate(" @._%+-():;,/=\"'#*&$!|<>\n[]{}?~"):
    _CLASS[ord(_c)] = 28 + _i
_CLASS[48], _CLASS[128] = 59, 60  # a nought often opens a number
CLASSES = 62  # the last one pads


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
    m = {"embed": n(CLASSES, EMBED, scale=0.5), "out": n(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        m |= {f"w_{d}": n(EMBED, 4 * HIDDEN), f"u_{d}": n(HIDDEN, 4 * HIDDEN), f"b_{d}": bias}
    return m


def _lstm(m: dict, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: [time, batch, EMBED] -> hidden [time, batch, HIDDEN]."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, held = np.empty((steps, batch, HIDDEN), np.float32), []
    given = x @ m[f"w_{d}"] + m[f"b_{d}"]
    for t in range(steps):
        z = given[t] + h @ m[f"u_{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        top = np.tanh(c)
        if keep:
            held.append((h, before, i, f, o, g, top))
        h = o * top
        out[t] = h
    return out, held


def _lstm_back(m: dict, d: str, x: np.ndarray, held: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    dx = np.empty_like(x)
    dh_next, dc_next = np.zeros_like(held[0][0]), np.zeros_like(held[0][0])
    for t in range(len(held) - 1, -1, -1):
        h, before, i, f, o, g, top = held[t]
        dh = dout[t] + dh_next
        dc = dh * o * (1 - top * top) + dc_next
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad[f"w_{d}"] += x[t].T @ dz
        grad[f"u_{d}"] += h.T @ dz
        grad[f"b_{d}"] += dz.sum(0)
        dx[t] = dz @ m[f"w_{d}"].T
        dh_next, dc_next = dz @ m[f"u_{d}"].T, dc * f
    return dx


def emissions(m: dict, codes: np.ndarray) -> np.ndarray:
    """codes: [batch, WINDOW] -> tag scores [batch, WINDOW, TAGS]."""
    x = m["embed"][codes.T]
    f, _ = _lstm(m, "f", x, False)
    b, _ = _lstm(m, "b", x[::-1], False)
    return (np.concatenate([f, b[::-1]], 2) @ m["out"] + m["out_b"]).transpose(1, 0, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _crf(move: np.ndarray, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and its gradients for emissions e [time, batch, TAGS] and gold tags y [time, batch]."""
    steps, batch, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + move[None], 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _lse(move[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    p = np.exp(a + b - z[None, :, None])
    dmove = np.zeros_like(move)
    rows = np.arange(batch)
    gold = e[0][rows, y[0]].sum()
    p[0][rows, y[0]] -= 1
    for t in range(1, steps):
        pair = np.exp(a[t - 1][:, :, None] + move[None] + (e[t] + b[t])[:, None, :] - z[:, None, None])
        dmove += pair.sum(0)
        np.subtract.at(dmove, (y[t - 1], y[t]), 1)
        gold += (e[t][rows, y[t]] + move[y[t - 1], y[t]]).sum()
        p[t][rows, y[t]] -= 1
    return float(z.sum() - gold), p, dmove


def train(codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 80, rate: float = 0.012, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the CRF's exact loss. codes, tags: [windows, WINDOW]."""
    m = new_model(seed)
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    r, n = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for at in np.array_split(r.permutation(len(codes)), max(1, len(codes) // batch)):
            x = m["embed"][codes[at].T]
            f, hf = _lstm(m, "f", x, True)
            b, hb = _lstm(m, "b", x[::-1], True)
            h = np.concatenate([f, b[::-1]], 2)
            _, de, dmove = _crf(m["move"], h @ m["out"] + m["out_b"], tags[at].T)
            g = {k: np.zeros_like(v) for k, v in m.items()}
            g["move"], g["out_b"] = dmove, de.sum((0, 1))
            g["out"] = np.einsum("tbh,tbk->hk", h, de)
            dh = de @ m["out"].T
            dx = _lstm_back(m, "f", x, hf, dh[..., :HIDDEN], g)
            dx += _lstm_back(m, "b", x[::-1], hb, dh[::-1][..., HIDDEN:], g)[::-1]
            np.add.at(g["embed"], codes[at].T, dx)
            n += 1
            slow = rate * (0.5 if epoch > epochs * 2 // 3 else 1.0)
            for k, v in m.items():
                d = np.clip(g[k] / len(at), -5, 5)
                one[k] += 0.1 * (d - one[k])
                two[k] += 0.01 * (d * d - two[k])
                v -= (slow * (one[k] / (1 - 0.9**n)) / (np.sqrt(two[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)
    return m


def viterbi(move: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Best tags of one stretch, e: [time, TAGS]."""
    n = len(e)
    back = np.zeros((n, TAGS), np.int64)
    s = e[0]
    for t in range(1, n):
        x = s[:, None] + move
        back[t] = x.argmax(0)
        s = x.max(0) + e[t]
    out = np.empty(n, np.int64)
    out[-1] = int(s.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _starts(n: int) -> np.ndarray:
    """Where the windows of a text of n characters begin."""
    return np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)


# ---- training spans


def _name(r: np.random.Generator, words: list[str]) -> str:
    """A local part: words, initials and numbers with the marks between them that addresses have."""
    own = [w for w in (re.sub(r"[^A-Za-z]", "", words[int(r.integers(0, len(words)))])[:10] for _ in range(2)) if w] or ["info"]
    own = [w.lower() if r.random() < 0.8 else w for w in own[: int(r.integers(1, 3))]]
    return ("", ".", "_", "-")[int(r.integers(0, 4))].join(own) + (str(int(r.integers(0, 2000))) if r.random() < 0.4 else "")


def _domain(r: np.random.Generator, words: list[str]) -> list[str]:
    own = [re.sub(r"[^A-Za-z]", "", words[int(r.integers(0, len(words)))]).lower()[:9] or "mail" for _ in range(int(r.integers(1, 3)))]
    return [*(w + (str(int(r.integers(1, 99))) if r.random() < 0.2 else "") for w in own), "com org net de fr eu io info example co.uk edu test".split()[int(r.integers(0, 12))]]


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def card_number(r: np.random.Generator, n: int = 16) -> str:
    """n digits that pass Luhn."""
    head = str(int(r.integers(3, 7))) + _digits(r, n - 2)
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def _fours(s: str, by: str) -> str:
    return by.join(s[i : i + 4] for i in range(0, len(s), 4))


def _octets(r: np.random.Generator) -> list[str]:
    return [str(int(x)) for x in r.integers(0, 256, 4)]


def _email(at: str, dot: str):
    return lambda r, w: _name(r, w) + at + dot.join(_domain(r, w))


def _address(dot: str):
    return lambda r, w: dot.join(_octets(r))


def _card(by: str, n: int = 16):
    return lambda r, w: _fours(card_number(r, n), by)


def _phone(lead: str, area: str, by: str):
    """A phone number: how it opens (c: a country's digits), its area code with or without brackets, and groups of digits."""

    def make(r, w):
        head = lead.replace("c", str(int(r.integers(20, 99))))
        groups = ((3, 4), (4, 4), (2, 2, 2), (3, 2, 2), (7,), (2, 4))[int(r.integers(0, 6))] if lead else (3, 4)
        first = area.replace("d", _digits(r, 3 if not lead else int(r.integers(2, 5))))
        return head + first + (" " if area != "d" and by != " " and r.random() < 0.5 else by) + by.join(_digits(r, n) for n in groups)

    return make


_AT = ("@", " @ ", " @", "@ ", "[at]", " [at] ", "(at)", " (at) ", " (AT) ", "{at}", " {at} ", "<at>", "[@]", "(@)", " at ", " AT ")
_DOT = (".", " . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", "{dot}")
#: Shapes of generated spans by (kind, name); each makes a text from a generator and some words. An at without marks comes with a written dot.
SHAPES = {(0, f"a{at}b{dot}c"): _email(at, dot) for at in _AT for dot in _DOT if not (at.strip().lower() == "at" and dot in (".", " . "))}
SHAPES |= {(1, f"1{dot}2"): _address(dot) for dot in (".", " . ", ". ", " .", "[.]", "(.)", "{.}", " dot ", "[dot]", "(dot)")}
SHAPES |= {(2, f"4{by}4"): _card(by) for by in ("", " ", "-", ".", "/", " - ", "  ", "_", ":")} | {(2, f"{n} digits"): _card("", n) for n in (17, 18, 19)}
SHAPES |= {(3, f"{lead}{area}{by}"): _phone(lead, area, by) for lead in ("+c ", "+c", "00c ", "00 c ", "+c (0)", "0", "") for area in ("d", "(d)") for by in (" ", "-", ".", "/") if lead != "0" or area == "d"}
del SHAPES[3, "d "], SHAPES[3, "d/"]  # three numbers and no mark of a phone


def choose(shapes, r: np.random.Generator) -> tuple[int, str]:
    """One of the shapes: phones come most often, as theirs vary most; each kind's plainest shape is as likely as five others."""
    kind = (0, 0, 1, 2, 3, 3, 3)[int(r.integers(0, 7))]
    own = [s for s in shapes if s[0] == kind] or list(shapes)
    own += [s for s in own if s[1] in ("a@b.c", "1.2", "4 4", "44", "+c d ", "d-")] * 4
    return own[int(r.integers(0, len(own)))]


#: Numbers and at signs that are no personal data.
OTHERS = (
    lambda r, w: str(int(r.integers(1000, 2100))),
    lambda r, w: _digits(r, int(r.integers(1, 9))),
    lambda r, w: f"{int(r.integers(0, 99))}.{int(r.integers(0, 99))}",
    lambda r, w: f"{int(r.integers(0, 20))}.{int(r.integers(0, 20))}.{int(r.integers(0, 20))}",
    lambda r, w: f"{int(r.integers(1, 999))},{_digits(r, 3)},{_digits(r, 3)}",
    lambda r, w: f"{int(r.integers(1, 99))} {_digits(r, 3)} {_digits(r, 3)}",
    lambda r, w: f"{int(r.integers(1900, 2100))}-{int(r.integers(1, 13)):02d}-{int(r.integers(1, 29)):02d}",
    lambda r, w: f"{int(r.integers(1, 29))}.{int(r.integers(1, 13))}.{int(r.integers(1900, 2100))}",
    lambda r, w: f"{int(r.integers(1, 13))}/{int(r.integers(1, 29))}/{int(r.integers(1900, 2100))}",
    lambda r, w: f"{int(r.integers(0, 24)):02d}:{int(r.integers(0, 60)):02d}" + (f":{int(r.integers(0, 60)):02d}" if r.random() < 0.5 else ""),
    lambda r, w: f"${int(r.integers(1, 999))}.{_digits(r, 2)}",
    lambda r, w: f"{int(r.integers(1, 400))}-{int(r.integers(1, 400))}",
    lambda r, w: f"{int(r.integers(1, 100))}%",
    lambda r, w: "0x" + "".join("0123456789abcdef"[int(x)] for x in r.integers(0, 16, int(r.integers(4, 33)))),
    lambda r, w: "".join("0123456789abcdefghijklmnopqrstuvwxyz"[int(x)] for x in r.integers(0, 36, int(r.integers(8, 40)))),
    lambda r, w: _digits(r, int(r.integers(20, 40))),
    lambda r, w: "ISBN 978-" + f"{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}",
    lambda r, w: "@" + _name(r, w),
    lambda r, w: f"{int(r.integers(2, 99))} @ {int(r.integers(2, 99))}",
    lambda r, w: f"at {_name(r, w)}",
    lambda r, w: f"{_name(r, w)} (at {_name(r, w)})",
    lambda r, w: f"[{int(r.integers(1, 99))}]",
    lambda r, w: f"{int(r.integers(1, 20))} x {int(r.integers(1, 20))} = {int(r.integers(1, 400))}",
    lambda r, w: ", ".join(str(int(x)) for x in r.integers(0, 300, int(r.integers(2, 6)))),
)


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One tag a character: of overlapping spans the first, longest one."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def snippets(text: str, most: int = SNIPPETS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Pieces of about three windows from anywhere in a text, with the base spans wholly inside: around some base spans, other cues and one place at random."""
    r = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    spans = _apart(base_spans(text))
    pick = lambda xs, n: [xs[int(i)] for i in r.permutation(len(xs))[:n]]
    cues = [m.start() for m in _CUE.finditer(text)]
    places = pick([a for _, a, _ in spans], most // 2) + pick(cues, most // 4)
    places.append(int(r.integers(0, max(1, len(text)))))
    out = []
    for at in places[:most]:
        lo = max(0, at - int(r.integers(WINDOW // 2, 2 * WINDOW)))
        hi = min(len(text), lo + 3 * WINDOW)
        inside = [(k, a - lo, b - lo) for k, a, b in spans if a >= lo and b <= hi]
        if any(a < lo < b or a < hi < b for _, a, b in spans):  # never a span cut in two
            cut = [(a, b) for _, a, b in spans if a < lo < b or a < hi < b]
            lo, hi = max([lo, *(b for a, b in cut if a < lo < b)]), min([hi, *(a for a, b in cut if a < hi < b)])
            inside = [(k, a - lo, b - lo) for k, a, b in spans if a >= lo and b <= hi]
        if hi > lo:
            out.append((text[lo:hi], inside))
    return out


def examples(given: list[tuple[str, list[tuple[int, int, int]]]], shapes=None, count: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: snippets with their own spans, and with generated spans and other numbers put in between their words."""
    r = np.random.default_rng(seed)
    shapes = list(SHAPES if shapes is None else shapes)
    words = [w for t, _ in given[:200] for w in t.split()[:20] if w[:1].isalpha()]
    words = words if len(words) > 20 else "anna works here office contact server maria green write call north house paper river".split()
    given = [g for g in given if len(g[0]) > 20] or [(" ".join(words[int(i)] for i in r.integers(0, len(words), 30)), []) for _ in range(50)]
    codes, tags = np.full((count, WINDOW), CLASSES - 1, np.int64), np.zeros((count, WINDOW), np.int64)
    for n in range(count):
        text, spans = given[int(r.integers(0, len(given)))]
        spans, focus = list(spans), int(r.integers(0, len(text)))
        if spans and r.random() < 0.5:
            focus = spans[int(r.integers(0, len(spans)))][1]
        for _ in range(0 if n % 5 == 0 else int(r.integers(1, 3))):
            at = text.find(" ", int(r.integers(0, len(text))))
            at = at if at >= 0 else len(text)
            if any(a <= at <= b for _, a, b in spans):
                continue
            if r.random() < 0.65:
                shape = choose(shapes, r)
                new, kind = SHAPES[shape](r, words), shape[0]
            else:
                new, kind = OTHERS[int(r.integers(0, len(OTHERS)))](r, words), None
            before = (" ", " ", " ", " ", "\n", ": ", ' "')[int(r.integers(0, 7))]
            after = '"' if before == ' "' else ("", "", "", ",", ".", ";", "\n")[int(r.integers(0, 7))]
            shift = len(before) + len(new) + len(after)
            spans = [(k, a + shift, b + shift) if a >= at else (k, a, b) for k, a, b in spans]
            if kind is not None:
                spans.append((kind, at + len(before), at + len(before) + len(new)))
            text = text[:at] + before + new + after + text[at:]
            focus = at
        at = max(0, focus - int(r.integers(5, WINDOW - 10)))
        part = classes(text[at : at + WINDOW])
        codes[n, : len(part)] = part
        for k, a, b in spans:
            tags[n, max(0, a - at) : max(0, b - at)] = k + 1
    return codes, tags


def marginals(move: np.ndarray, e: np.ndarray) -> np.ndarray:
    """P(tag) of each character of one stretch, e: [time, TAGS]."""
    a, b = np.empty(e.shape), np.zeros(e.shape)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = e[t] + _lse(a[t - 1][:, None] + move, 0)
    for t in range(len(e) - 2, -1, -1):
        b[t] = _lse(move + (e[t + 1] + b[t + 1])[None, :], 1)
    return np.exp(a + b - _lse(a[-1][None, :], 1))


#: Marks around a span that are none of it.
_EDGE = frozenset(" \t\r\n,.;:!?\"'")


def model_spans(m: dict, texts: list[str], bases: list[list[tuple[int, int, int]]], accept: float = ACCEPT) -> list[list[tuple[int, int, int]]]:
    """Spans that the model adds to each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    jobs, rows = [], []
    for k, text in enumerate(texts):
        cues = np.array([x.start() for x in _CUE.finditer(text)], np.int64)
        if not len(cues):
            continue
        starts = _starts(len(text))
        held = np.searchsorted(cues, starts + WINDOW + REACH) > np.searchsorted(cues, starts - REACH)
        codes = None
        for at in starts[held].tolist():
            if codes is None:
                codes = classes(text)
            row = np.full(WINDOW, CLASSES - 1, np.int64)
            part = codes[at : at + WINDOW]
            row[: len(part)] = part
            jobs.append((k, at))
            rows.append(row)
    if not rows:
        return found
    weight = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)
    scored = np.concatenate([emissions(m, np.stack(rows[i : i + 512])) for i in range(0, len(rows), 512)])
    i = 0
    while i < len(jobs):
        k, begin = jobs[i]
        j = i
        while j + 1 < len(jobs) and jobs[j + 1][0] == k and jobs[j + 1][1] <= jobs[j][1] + WINDOW // 2:
            j += 1
        end = min(jobs[j][1] + WINDOW, len(texts[k]))
        total, mass = np.zeros((end - begin, TAGS), np.float32), np.zeros(end - begin, np.float32)
        for x in range(i, j + 1):
            lo = jobs[x][1] - begin
            size = min(WINDOW, end - begin - lo)
            total[lo : lo + size] += scored[x, :size] * weight[:size, None]
            mass[lo : lo + size] += weight[:size]
        reconciled = total / mass[:, None]
        tags = viterbi(m["move"], reconciled)
        cuts = np.flatnonzero(np.append(True, tags[1:] != tags[:-1])).tolist()
        runs = [(a, b, int(tags[a])) for a, b in zip(cuts, [*cuts[1:], len(tags)], strict=True) if tags[a]]
        base = bases[k]
        runs = [x for x in runs if not any(a < begin + x[1] and begin + x[0] < b for _, a, b in base)]
        if runs:
            p = marginals(m["move"], reconciled)
            text = texts[k]
            for a, b, tag in runs:
                if p[a:b, tag].mean() < accept:
                    continue
                a, b = begin + a, begin + b
                while a < b and text[a] in _EDGE:
                    a += 1
                while b > a and text[b - 1] in _EDGE:
                    b -= 1
                if tag == 3 and not luhn(_NOT_DIGIT.sub("", text[a:b])):
                    continue  # by its definition no card number
                if b - a > 5 and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
                    found[k].append((tag - 1, a, b))
        i = j + 1
    return found


def training_snippets(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Snippets of at most ``sample`` texts with a base span and as many others; a bounded number of characters reaches the driver."""

    def rows(batches):
        for part in slices(batches, 1, rows=64):
            made = [snippets(t) for t in part.column(1).to_pylist()]
            has = [any(spans for _, spans in x) for x in made]
            flat = [[{"text": t, "spans": [list(s) for s in spans]} for t, spans in x] for x in made]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(flat, pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]))), pa.array(has)], names=["row", "made", "has_span"])

    known = docs.where("length(text) > 20")
    # keys are ranked alone; of the bounded pool that they name, the texts are read and searched for spans where they lie
    cued = F.col("text").rlike("[0-9@]")
    pools = [known.where(x).select("row").distinct().orderBy(F.xxhash64("row"), "row").limit(n) for x, n in ((cued, 6 * sample), (~cued, sample))]
    keys = pools[0].unionByName(pools[1])
    pool = staged(known.join(F.broadcast(keys), "row", "left_semi").select("row", "text").dropDuplicates(["row"]).mapInArrow(rows, "row long, made array<struct<text:string,spans:array<array<int>>>>, has_span boolean"))
    out = []
    for has in (True, False):
        few = pool.where(F.col("has_span") == has).orderBy(F.xxhash64("row"), "row").limit(sample)
        out += [(x["text"], [tuple(s) for s in x["spans"]]) for row in few.collect() for x in row["made"]]
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, accept: float = ACCEPT, count: int = EXAMPLES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans: one row for each row of ``docs``."""
    narrow = keyed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(*examples(training_snippets(narrow, sample), count=count)))

    def make():
        m = shared.value

        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = model_spans(m, texts, bases, accept)
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(show(b).encode()).hexdigest() for b in bases]
            every = [show([*b, *a]) for b, a in zip(bases, added, strict=True)]
            return pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest), pa.array(every), pa.array([len(a) for a in added], pa.int64()), pa.array([len(a) + len(b) for a, b in zip(added, bases, strict=True)], pa.int64())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

        return f

    return map_text(spread(narrow), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document: the base patterns' and the model's."""
    return find_personal_data(table(spark, sf_dir, "documents"))
