import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ngram_join as J
from quarry.llm import shingles as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, num=75, den=100):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return sorted((str(d), len(s), str(d if not s else low.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def ran(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' AS node", "1 AS component_id", "2L AS n_shingles")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.ngram_join(df.repartition(5)).collect())


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(n)]
    while True:
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(copy))
            copy[at:at + rng.randint(0, 2)] = [rng.choice(words)]
        yield " ".join(copy)


def corpus(seed, families, spread):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for size, n, edits in families:
        f = family(rng, words, n, edits)
        texts += [next(f) for _ in range(size)]
    texts += [passage + " " + next(family(rng, words, rng.randint(20, 90), 0)) for _ in range(spread)]
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    texts = corpus(1, [(60, 120, 4), (25, 60, 2), (12, 300, 12), (8, 9, 1), (30, 200, 30)], 40)
    texts += ["", " \n\t", "one", "ONE", "one two", "one two three four", "one two three four five", "Ab c d e f g", "ab C d e f g"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got, want = ran(spark, rows, extra=True), brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 70


def test_nulls_repeats_and_empty(spark):
    long = "w" + " w".join(map(str, range(30_000)))
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, None), (8, ""), (None, None), (None, "q r"),
            (1, long), (2, long + " more"), (3, "x" * 3_000_000)]
    assert ran(spark, rows) == brute(rows)
    assert J.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_shingles_against_python(monkeypatch, piece):
    monkeypatch.setattr(S, "SLICE", piece)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\n\tß") for _ in range(rng.randint(0, 150))) for _ in range(200)] + ["", "a", "x" * 400]
    sets = dict(S.shingle_sets(pa.array(texts), 5))
    want = [shingle_set(t) for t in texts]
    assert [len(sets[i]) for i in range(len(texts))] == [len(s) for s in want]
    for i in range(1, len(texts)):
        assert len(np.intersect1d(sets[i], sets[i - 1])) == len(want[i] & want[i - 1])


def test_tree_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 6, (40, J.DIMS)) * (rng.random((40, J.DIMS)) < 0.3)
    p = np.concatenate([base + (rng.random((40, J.DIMS)) < 0.03) for _ in range(8)]).astype(np.int32)
    n = p.sum(1).astype(np.int64)
    got = {tuple(sorted(x)) for i, j in J.tree_pairs(J.RTree(p, n), 75, 100, lambda i, j: np.ones(len(i), bool)) for x in zip(i, j)}
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p))
            if 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and np.minimum(p[i], p[j]).sum() >= J.need(n[i], n[j], 75, 100)}
    assert want <= got
    full = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p))}
    assert len(got) < len(full) / 2


def test_query_against_brute_force(spark):
    from quarry.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = QUERIES["op1_ngram_join"](spark, d).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def near_copies(n, seed=4):
    """Copies of a text of 200 words with three words changed in each: pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    texts = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("n", [150, 600])
def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch, n):
    verified = []
    verify = J.verify

    def counted(texts, keys, pairs, *args):
        verified.append(pairs.count())
        return verify(texts, keys, pairs, *args)
    monkeypatch.setattr(J, "verify", counted)
    rows = [(i, t) for i, t in enumerate(near_copies(n))]
    assert ran(spark, rows) == brute(rows)
    assert sum(verified) < 12 * n, verified


def test_parts_of_a_cell_keep_every_pair_that_can_link():
    from quarry.llm.ngram_join import parted, possible
    rng = np.random.default_rng(3)
    cell = np.sort(rng.integers(0, 60, 900))
    n = np.exp(rng.uniform(2, 7, 900)).astype(np.int64)
    p = (rng.random(900) * (n // 4 + 1)).astype(np.int64)
    node = rng.permutation(900)
    order = np.lexsort((node, cell))
    cell, n, p, node = cell[order], n[order], p[order], node[order]
    part, kept, _ = parted(cell, node, (n << 32) | p, 75, 100)
    of = dict(zip(kept.tolist(), part.tolist()))
    i, j = np.triu_indices(900, 1)
    can = (cell[i] == cell[j]) & possible(n[i], p[i], n[j], p[j], 75, 100)
    assert can.sum() > 100
    assert all(of.get(a, -1) == of.get(b, -2) for a, b in zip(node[i[can]].tolist(), node[j[can]].tolist()))
    assert len(kept) < 0.9 * 900                                    # sets that can't link leave the cell
    assert len(np.unique(part)) > len(np.unique(cell))


def test_components_of_stars_take_one_round(spark, monkeypatch):
    from quarry.llm import components as K
    made = []
    monkeypatch.setattr(K, "written", lambda df, name, w=K.written: made.append(name) or w(df, name))
    links = spark.createDataFrame([(1, 2), (1, 3), (7, 8)], "a long, b long")
    out = {tuple(r) for r in K.components(links).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert len(made) == 2                                           # the edges and one round that leaves them
    made.clear()
    assert K.components(links.limit(0)).collect() == []
    assert len(made) == 1


def tasks_of(spark, run):
    """What ``run`` returns, and the tasks of its jobs."""
    sc, group = spark.sparkContext, "tasks_of"
    sc.setJobGroup(group, group)
    try:
        out = run()
        track = sc.statusTracker()
        stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
        return out, sum(track.getStageInfo(s).numCompletedTasks for s in stages if track.getStageInfo(s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components_take_few_tasks(spark):
    """The driver keeps a record of every task: on 20 shuffle partitions without coalescing a round takes few."""
    from quarry.llm import components as K
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for p in pairs if p[0] != p[1] for x in p}
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    made = []
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(K, "written", lambda df, name, w=K.written: made.append(name) or w(df, name))
            out, tasks = tasks_of(spark, lambda: K.components(links))
        assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
        rounds = made.count("large") or made.count("edges") - 1
        assert rounds > 2
        assert tasks / rounds < 150
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_broadcasts_leave_the_driver(spark, monkeypatch):
    from pyspark import SparkContext
    sent, gone = [], []
    make = SparkContext.broadcast

    def broadcast(self, value):
        b = make(self, value)
        sent.append(b)
        monkeypatch.setattr(b, "destroy", lambda *a, d=b.destroy: gone.append(b) or d(*a))
        return b
    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:40 - i % 3])) for i in range(6)] + [(9, "other words that nobody else has at all")]
    assert ran(spark, rows) == brute(rows)
    assert len(sent) >= 2 and {id(b) for b in sent} == {id(b) for b in gone}
