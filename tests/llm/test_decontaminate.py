import random

import numpy as np
import pyarrow as pa

from quarry.llm import decontaminate as D


def hashes(texts):
    return [h for _, h in D.documents_words(pa.array(texts))]


def table_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequence_against_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert D.lcs(a, b) == table_lcs(a.tolist(), b.tolist())


def brute(docs, items):
    """Every stretch of every document against every item, without retrieval."""
    out = set()
    d, q = hashes([t or "" for _, t in docs]), hashes([t or "" for _, t in items])
    for (i, _), h in zip(docs, d):
        for (k, _), item in zip(items, q):
            if len(item) and np.isin(h, item).sum() >= D.LOOSE * len(item):
                ans = item[-min(D.ANSWER, max(1, len(item) // 3)):]
                for at in range(0, max(1, len(h) - D.STEP), D.STEP):
                    if D.verdict(h, item, ans, at, at + D.WINDOW)[2]:
                        out.add((i, k))
                        break
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 8))) for _ in range(3000)] + ["the", "of", "and"] * 500
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randint(15, 60))) for k in range(40)]
    docs = [prose(rng.randint(1, 300)) for _ in range(150)]
    planted = set()
    for k, t in items:
        w = t.split()
        loose = [x for x in w[:-8] if rng.random() > 0.12] + w[-8:]
        for part in (t.translate({c: c - 32 for c in range(97, 123)}), " ".join(loose), t.replace(" ", ", ")):
            planted.add((len(docs), k))
            docs.append(prose(rng.randint(0, 100)) + " " + part + " " + prose(rng.randint(0, 100)))
    return list(enumerate(docs)), items, planted


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2.0 AS cosine").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"))


def test_recall_and_clean_documents(spark):
    docs, items, planted = corpus(1)
    got = {(r.doc_id, r.item_id) for r in D.leaks(*frames(spark, docs, items)).collect()}
    want = brute(docs, items)
    assert planted <= want
    assert got <= want and len(got & want) >= 0.97 * len(want)
    assert want == planted
    kept = {r.doc_id for r in D.decontaminate(*frames(spark, docs, items)).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, " ".join(f"w{i}" for i in range(40_000)) + " " + item), (5, "short one"),
            (6, "very short one here"), (7, "x" * 2_000_000)]
    items = [(1, item), (2, item.upper()), (3, None), (4, "  "), (5, "short one")]
    got = sorted((str(r.doc_id), r.item_id) for r in D.leaks(*frames(spark, docs, items)).collect())
    assert got == sorted([(d, k) for d in ("None", "3", "3", "4") for k in (1, 2)] + [("5", 5), ("6", 5)])
    assert D.leaks(*frames(spark, [], items)).collect() == []
    assert D.leaks(*frames(spark, docs, [])).collect() == []
    kept = D.decontaminate(*frames(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "item_id", "cosine"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7]


def test_answer_column(spark):
    docs = [(1, "one two three four five six seven eight nine ten then the capital is oslo today"), (2, "one two three four five six seven eight nine ten")]
    docs += [(i, f"other text number {i} q1 q2 q3 q4") for i in range(10, 60)]
    item = "one two three q1 four five six q2 q3 seven eight nine q4 ten"
    bench = spark.createDataFrame([(7, item, "Oslo")], "item_id long, text string, answer string")
    got = D.leaks(frames(spark, docs, [(1, "x")])[0], bench, answer_col="answer").collect()
    assert [(r.doc_id, r.item_id, r.answer_found) for r in got] == [(1, 7, True)]


def test_query_recall(spark):
    from quarry.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got, want = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, d).collect()}, brute(docs, items)
    assert got <= want and len(got) >= 0.9 * len(want)


def planted_corpus(seed, sizes, changed, tail=0, plants=200):
    """Items of the given sizes, the first ``plants`` planted once each with a share of their words (but the last ``tail``) replaced."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 8))) for _ in range(3000)] + ["the", "of", "and"] * 500
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate(sizes(rng))]
    docs, planted = [(i, prose(rng.randint(1, 300))) for i in range(100)], set()
    for k, t in items[:plants]:
        w = t.split()
        swap = set(rng.sample(range(len(w) - tail), int(changed * len(w))))
        part = " ".join(rng.choice(words) if i in swap else x for i, x in enumerate(w))
        planted.add((len(docs), k))
        docs.append((len(docs), f"{prose(rng.randint(0, 100))} {part} {prose(rng.randint(0, 100))}"))
    return docs, items, planted


def recall(spark, docs, items, planted):
    """The share of the planted pairs that is found; all are leaks by :func:`brute`, and so is what else is found."""
    pairs = lambda found: {x for i, k in found for x in brute([docs[i]], [items[k]])}
    assert pairs(planted) == planted
    got = {(r.doc_id, r.item_id) for r in D.leaks(*frames(spark, docs, items)).collect()}
    assert pairs(got) == got
    return len(got & planted) / len(planted)


def test_recall_with_many_items(spark):
    for number, changed in ((1000, 0.18), (4000, 0)):
        case = planted_corpus(number, lambda rng: [rng.randint(15, 60) for _ in range(number)], changed)  # noqa: B023
        assert recall(spark, *case) >= 0.99


def test_recall_of_short_long_and_reworded_items(spark):
    for size, changed, tail in (((5, 14), 0, 0), ((100, 600), 0, 0), ((30, 60), 0.4, 8)):
        case = planted_corpus(7, lambda rng: [rng.randint(*size) for _ in range(300)], changed, tail, plants=80)  # noqa: B023
        assert recall(spark, *case) >= 0.99


def test_directions_are_fitted_on_every_passage(spark):
    import quarry.llm.decontaminate as D
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 150)) for _ in range(40)] + ["", " ".join(["w1"] * 40)]
    items = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(20)]
    idf, known, v = D.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5),
                          spark.createDataFrame([(t,) for t in items], "text string"))

    import pyarrow as pa
    hashes = lambda rows: [D.feature(h) for _, h in D.documents_words(pa.array(rows))]      # noqa: E731
    assert known.tolist() == sorted(set(np.concatenate(hashes(items)).tolist()))
    count = lambda f: np.bincount(f, minlength=1 << D.BITS) * idf                           # noqa: E731
    passages = [count(f[a:a + D.WINDOW]) for f in hashes(texts) for a in range(0, len(f), D.WINDOW)]
    mass = sum((idf[f] ** 2).sum() for f in hashes(texts))
    rows = np.array([x / np.linalg.norm(x) for x in map(count, hashes(items))]
                    + [x * np.sqrt(D.WEIGHT * len(texts) / mass) for x in passages])[:, known]
    c = rows.T @ rows
    s = D.sketch(known)[:-1] / idf[known][:, None]
    low = c @ s @ np.linalg.pinv(s.T @ c @ s, rcond=1e-10, hermitian=True) @ s.T @ c
    values, vectors = np.linalg.eigh(low)
    want = vectors[:, np.argsort(values)[::-1][:D.RANK]]
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-2)
    assert len(known) > D.RANK
