import hashlib
import random

import numpy as np

from quarry.llm import suffix_dedup as D

L = D.LENGTH


def brute(rows, keep, length=L):
    """Every window of every text in a dictionary; order of texts by (id, null last), then place."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    raws = [(t or "").encode() for _, t in rows]
    places: dict = {}
    for i in order:
        for x in range(len(raws[i]) - length + 1):
            places.setdefault(raws[i][x:x + length], []).append((i, x))
    gone = [bytearray(len(r)) for r in raws]
    for found in places.values():
        for i, x in (found if keep == "none" else found[1:]) if len(found) > 1 else ():
            gone[i][x:x + length] = b"\x01" * length
    out = []
    for (d, _), r, g in zip(rows, raws, gone):
        g = np.frombuffer(bytes(g), np.uint8).astype(bool)
        left = bytes(np.frombuffer(r, np.uint8)[~g]) if len(r) else b""
        out.append((str(d), len(r), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def ran(spark, rows, keep, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_bytes", "'x' AS txt", "2 AS kinds")
    return sorted((str(r.row.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in D.suffix_dedup(df.repartition(4), keep=keep, **kw).collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(30, 120)) for _ in range(6)]
    base = prose(700)
    rows = [prose(rng.randint(1, 80)) for _ in range(30)]
    rows += [prose(40) + " " + rng.choice(passages) + " " + prose(30) for _ in range(30)]
    for _ in range(15):
        copy = base.split(" ")
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [passages[0] + passages[1] + passages[0], "ab" * 400, "a" * 700, "a" * 200, "a" * 199, "b" * 201, "xyz" * 500, ("pq" * 150) + "r" + ("pq" * 150), passages[2], passages[2], base, base]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_every_copy_goes(spark):
    rows = corpus(1)
    assert ran(spark, rows, "none") == brute(rows, "none")


def test_first_copy_stays(spark):
    rows = corpus(2)
    assert ran(spark, rows, "first") == brute(rows, "first")


def test_hot_cells_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT", 2)
    rows = corpus(3)
    for keep in ("none", "first"):
        assert ran(spark, rows, keep) == brute(rows, keep)


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(4)
    part = bytes(rng.choice(b"abcd") for _ in range(3000))
    data = np.frombuffer(part + b"-" + part, np.uint8)
    whole = D.fragments(data, np.array([0, len(data)]), L, D.GRAM)
    assert int(whole[2].sum()) == len(data) - L + 1
    monkeypatch.setattr(D, "PIECE", 1000)
    import pyarrow as pa
    b = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([data.tobytes().decode()])], names=["txt", "ord", "text"])
    spans = [s for out in D._entries([b], L, D.GRAM) for s in out.column(6).to_pylist()]
    assert sorted(x for s in spans for x in range(s >> 8, (s >> 8) + (s & 127))) == list(range(len(data) - L + 1))


def test_copies_are_combined_before_the_shuffle():
    import pyarrow as pa
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef ") for _ in range(600))
    texts = ["".join(rng.choice("abcdef ") for _ in range(300)) + passage for _ in range(50)]
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array(texts)], names=["txt", "ord", "text"])
    out = pa.Table.from_batches(D._entries([b], L, D.GRAM)).to_pydict()
    sent = [(c, f) for c, f, k in zip(out["cell"], out["frag"], out["kind"]) if k < 2]
    assert len(sent) == len(set(sent)) and out["kind"].count(2) > 49 * 3
    assert all(r == t for r, t, k in zip(out["route"], out["txt"], out["kind"]) if k == 2)


def test_nulls_repeats_empty(spark):
    long = "w " * 200_000 + "end"
    rows = [(None, "q" * 300), (3, "q" * 300), (3, None), (None, None), (5, ""), (6, long), (7, "é" * 150 + "z" + "é" * 150)]
    assert ran(spark, rows[:6], "none")[-1][0] == "None"
    small = rows[:5] + rows[6:]
    for keep in ("none", "first"):
        assert ran(spark, small, keep) == brute(small, keep)
    assert D.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = D.suffix_dedup(spark.createDataFrame([(1, "é" * 150 + "z" + "é" * 150)], "doc_id long, text string"), keep="first").first()
    assert out.kept_text == "éz"


def test_query_against_brute_force(spark):
    from quarry.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = QUERIES["op2_suffix_dedup"](spark, d).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, "none")
