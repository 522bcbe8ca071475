"""Counts and scores against a plain model of one token at a time, gradients, normalisation, held-out gain and odd rows."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from quarry.llm import lm_scoring as L
from quarry.llm.queries import QUERIES

from tests.conftest import SF_CHECK

SCHEMA = "doc_id long, text string, key int, token string"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(parts)


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)] + [L.END]


def held(i):
    return i is not None and crc32(str(i).encode()) % 10 == 0


class Plain:
    """The same model from whole dictionaries."""

    def __init__(self, rows, tables, known_share=L.KNOWN_SHARE):
        every = Counter(w for _, t in rows for w in plain_words(t))
        least = sum(every.values()) / known_share
        self.c = Counter(w for i, t in rows if not held(i) for w in plain_words(t))
        self.n, self.v, self.tables = sum(self.c.values()), len(self.c), tables
        ranked = sorted((w for w in self.c if every[w] >= least or w == L.END), key=lambda w: (w != L.END, -self.c[w], w))[:L.WORDS]
        self.rank = {w: k for k, w in enumerate(ranked)}
        self.tail_n, self.tail_v = Counter(), Counter()
        for w, c in self.c.items():
            if w not in self.rank:
                self.tail_n[L.tail_class(w)] += c
                self.tail_v[L.tail_class(w)] += 1
        self.bias = [math.log(s) if (s := sum(self.c[w] for w in ranked[k * L.SLOTS:(k + 1) * L.SLOTS])) else -1e4 for k in range(L.HEAD)]
        self.bias += [math.log(self.tail_n[k] + 0.1 * (self.tail_v[k] + 1)) for k in range(L.TAIL)]
        self.ranked = ranked

    def context(self, w):
        return L.START if w is None else self.rank.get(w, L.WORDS + L.tail_class(w))

    def log10(self, w, before, earlier):
        b, e = (np.array([self.context(x)], dtype=np.uint32) for x in (before, earlier))
        rows = [int(b[0]), int(e[0]) + L.CONTEXTS, int(L._hashed(b, e, rows=L.ROWS1, base=2 * L.CONTEXTS)[0])]
        z = np.array(self.bias) + sum(self.tables[0][r].astype(float) for r in rows)
        z -= z.max() + math.log(np.exp(z - z.max()).sum())
        if w not in self.rank:
            k = L.tail_class(w)
            return z[L.HEAD + k] / math.log(10) + math.log10((self.c[w] + 0.1) / (self.tail_n[k] + 0.1 * (self.tail_v[k] + 1)))
        k, slot = divmod(self.rank[w], L.SLOTS)
        c = np.array([k], dtype=np.uint32)
        rows = [int(x[0]) for x in (L._hashed(c, b, rows=L.ROWS2), L._hashed(c + np.uint32(L.HEAD), e, rows=L.ROWS2), L._hashed(c, b, e, rows=L.ROWS2))]
        members = self.ranked[k * L.SLOTS:(k + 1) * L.SLOTS]
        y = np.array([math.log(self.c[m]) for m in members]) + sum(self.tables[1][r][:len(members)].astype(float) for r in rows)
        y -= y.max() + math.log(np.exp(y - y.max()).sum())
        return (z[k] + y[slot]) / math.log(10)

    def row(self, i, text):
        words = plain_words(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in words)
        score = sum(self.log10(w, words[k - 1] if k else None, words[k - 2] if k > 1 else None) for k, w in enumerate(words))
        return (i, held(i), len(words), sum(self.c[w] > 0 for w in words), self.n, base, score)


def random_tables(scale=0.3):
    rng = np.random.default_rng(7)
    return [(scale * rng.standard_normal((L.ROWS1, L.CLASSES))).astype(np.float32), (scale * rng.standard_normal((L.ROWS2, L.SLOTS))).astype(np.float32)]


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)] + ["Über", "İstanbul", "x\x1cy", "a\x85b", " ", "\x00", "ÄÖ", "Z"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choices(words, weights, k=rng.randrange(1, 120)))) for i in range(120)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]
    return rows + [(None, "w1 w2 unseen-here"), (None, "w1"), (7, None), (8, ""), (9, " \n"), (10, "w1 " * 70000 + "W2"), (10, "only here")]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5], (g, w)
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-4), (g, w)


@pytest.mark.parametrize("known_share", [1 << 20, 200, 1])
def test_against_a_plain_model(spark, monkeypatch, known_share):
    rows, tables = corpus(), random_tables()
    rows[-2] = (10, "w1 " * 70000 + "W2") if known_share == 200 else (10, "w1 " * 70 + "W2")
    monkeypatch.setattr(L, "train", lambda docs, v: tables)
    out = L.lm_scores(frame(spark, rows), known_share=known_share)
    assert out.columns == COLUMNS
    plain = Plain(rows, tables, known_share)
    memo: dict = {}
    log10 = plain.log10
    plain.log10 = lambda *a: memo[a] if a in memo else memo.setdefault(a, log10(*a))
    same([tuple(r) for r in out.collect()], [plain.row(*r) for r in rows])


def test_probabilities_add_up():
    rows = corpus()[:150]
    plain = Plain(rows, random_tables())
    unseen = {}
    k = 0
    while len(unseen) < L.TAIL:
        w = f"?{k}".encode()
        unseen.setdefault(L.tail_class(w), w)
        k += 1
    for before, earlier in ((None, None), (b"w1", None), (b"w0", b"w2"), (b"zz", b"w1")):
        assert sum(10 ** plain.log10(w, before, earlier) for w in [*plain.c, *unseen.values()]) == pytest.approx(1, abs=1e-6)


def test_gradient():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((20, 6)).astype(np.float32)
    bias = rng.standard_normal(6).astype(np.float32)
    rows = [rng.integers(0, 20, 50).astype(np.uint16) for _ in range(3)]
    target = rng.integers(0, 6, 50)

    def loss(t):
        z = bias + sum(t[r] for r in rows)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(50), target]).sum())

    learner = L._Learner(table)
    learner.update(bias, rows, target)
    step = (learner.old - learner.table) * np.sqrt(learner.squares)[:, None] / L.RATE
    t = table.astype(np.float64)
    for i, j in ((0, 0), (3, 2), (7, 5), (19, 1)):
        up, down = t.copy(), t.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(step[i, j], abs=1e-3)
    assert loss(learner.table) < loss(table)
    assert learner.met.sum() == 150


def test_held_out_documents_gain(spark):
    out = QUERIES["op12_lm_scoring"](spark, SF_CHECK).toPandas()
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()
    plain = Plain([tuple(r) for r in docs], None)
    by_id = {r.doc_id: r for r in out.itertuples()}
    assert len(out) == len(docs) == len(by_id)
    for i, text in docs:
        words = plain_words(text)
        base = sum(math.log10((plain.c[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in words)
        assert (by_id[i].n_tokens, by_id[i].n_known, by_id[i].train_tokens) == (len(words), sum(plain.c[w] > 0 for w in words), plain.n)
        assert by_id[i].base_score == pytest.approx(base, rel=1e-9)
    h = out[out.held_out]
    assert 0.05 < len(h) / len(out) < 0.15
    assert h.score.sum() > h.base_score.sum() * 0.97  # at least 3 % fewer digits a token


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 7)
    text = ("Word wörd  a\n" * 20 + "x" * 50 + " end").encode()
    assert [w for ws in L.words_of(text) for w in ws] == text.lower().split()


@pytest.mark.parametrize("rows", [[], [(i, "some words") for i in range(200) if held(i)][:3]])
def test_nothing_to_learn_from(spark, rows):
    got = [tuple(r) for r in L.lm_scores(frame(spark, rows, 2)).collect()]
    assert [g[:5] for g in got] == [(i, True, 3, 0, 0) for i, _ in rows]
    assert all(g[5] == 0 and math.isfinite(g[6]) and g[6] <= 0 for g in got)
