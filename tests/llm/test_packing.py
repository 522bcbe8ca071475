import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import packing as P
from quarry.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def library(text):
    return P.load(PATH)[0].encode(text or "", add_special_tokens=False).ids + [P.END]


def check(rows, pieces, size=P.SIZE):
    """Every id in exactly one piece, digests of the library's ids, sequences without gaps, all full but the last."""
    left = sorted(((str(i), tuple(library(t))) for i, t in rows))
    docs: dict = {}
    for p in pieces:
        docs.setdefault((str(p.doc_id), p.doc_tokens, (p.sequence_id * size + p.offset) - p.start), []).append(p)
    got = []
    for (i, n, _), ps in docs.items():
        ps.sort(key=lambda p: p.start)
        assert ps[0].start == 0 and all(a.start + a.length == b.start for a, b in itertools.pairwise(ps)) and ps[-1].start + ps[-1].length == n
        for at, (j, ids) in enumerate(left):
            if j == i and len(ids) == n and all(zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in ps):
                got.append(left.pop(at))
                break
    assert not left and len(got) == len(rows)
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == size for s in range(len(fill) - 1))


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        x = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = P.hilbert(x, bits)
        assert sorted(key) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"aB' \n\t\u0301éΣ.9", "\u00a0", "<|endoftext|>", "don't", "語"]), max_size=40))
def test_parts_encode_like_the_whole(parts):
    text = "".join(parts)
    assert np.frombuffer(P.encode([text], PATH)[0], np.uint16).tolist() == library(text)[:-1]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 20)
    texts = [" ".join(f"w{i}" for i in range(50)), "", "w1 w2"]
    assert [np.frombuffer(x, np.uint16).tolist() for x in P.encode(texts, PATH)] == [library(t)[:-1] for t in texts]


def test_edges(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "word " * 20_000), (4, "same text"), (4, "same text"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS uid", "'k' AS key").repartition(3)
    check(rows, P.pack(df, PATH).collect())
    assert P.pack(df.limit(0), PATH).collect() == []
    out = P.pack(df, PATH, size=64, with_ids=True).collect()
    check(rows, out, 64)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in out)


def test_query_on_whole_table(spark):
    from quarry.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, QUERIES["op9_packing"](spark, d).collect())


def test_neighbours_share_sequences(spark):
    """Documents of one language lie together along the curve more often than by chance."""
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    from quarry.llm.queries import QUERIES
    line = sorted(QUERIES["op9_packing"](spark, d).collect(), key=lambda p: (p.sequence_id, p.offset))
    order = [p.doc_id for p in line if p.start == 0]
    same = np.mean([lang[a] == lang[b] for a, b in itertools.pairwise(order)])
    share = np.array([list(lang.values()).count(x) for x in set(lang.values())]) / len(lang)
    assert same > (share ** 2).sum() + 0.1
