import hashlib
import os
import struct

import pytest

from quarry.llm import warc as W


def expected(rows):
    first: dict = {}
    n: dict = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= W.LEAST:
            n[raw] = n.get(raw, 0) + 1
            if i is not None:
                first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = raw in first and n[raw] > 1 and i != first[raw]
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(first[raw] if again else None)))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    page = "<html><body>" + "<p>some line of text é</p>" * 40 + "</body></html>"
    rows = [(i, f"http://a.b/{i}?x=é y\r\n", page if i % 3 else page + str(i)) for i in range(200)]
    rows += [(None, None, page), (900, None, None), (901, "u", ""), (902, "u", "x" * 99), (903, "u", "x" * 99), (904, "u", "x" * 100),
             (905, "u", "x" * 100), (904, "u", "x" * 100), (None, "u", "y" * 150), (None, "u", "y" * 150), (906, "u", "z\r\n\r\n" * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS records").repartition(3)
    manifest = W.write_archives(df, str(tmp_path / "w"), roll=60_000)
    got = W.read_archives(manifest).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expected(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert manifest.count() > 3
    for m in manifest.collect():
        data = open(m.path.removeprefix("file:"), "rb").read()
        assert len(data) == m.archive_bytes and struct.unpack_from("<I", data)[0] == 0x184D2A5D
    files = set(os.listdir(tmp_path / "w"))
    assert files == {os.path.basename(m.path) for m in manifest.collect()}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(df)).collect() == []


def test_damage_is_seen():
    raws = [W.record(i, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None, False) for i in range(40)]
    held = W.dictionary(raws)
    data = W.opening(held) + b"".join(W.compress(raws, held))
    assert list(W.frames(data)) == raws
    with pytest.raises(ValueError):
        list(W.frames(data[:-5]))
    with pytest.raises(ValueError):
        W.parse(raws[0].replace(b"abcabc", b"abcabd"))
    with pytest.raises(ValueError):
        list(W.frames(b"\0" * 20))


def test_dictionary_helps():
    raws = [W.record(i, f"http://h/{i}", f"<html><head><title>page {i}</title></head><body>menu menu footer {i * 7919}</body></html>".encode(), "0" * 64,
                     None, False) for i in range(300)]
    held = W.dictionary(raws)
    import zstandard
    plain = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(r)) for r in raws)
    assert sum(map(len, W.compress(raws, held))) + len(W.opening(held)) < plain


def test_every_archive_trains_on_its_full_share(spark, tmp_path, monkeypatch):
    """Several archives above ``TRAIN_BYTES`` in one task: each dictionary comes from TRAIN_BYTES of its own records."""
    import pyarrow as pa
    from pyspark import TaskContext
    trained = []
    kept = W.dictionary
    monkeypatch.setattr(W, "dictionary", lambda records: trained.append(sum(map(len, records))) or kept(records))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    html = ["".join(chr(97 + (i * j * 7919) % 26) for j in range(20_000)) for i in range(1, 41)] * 13
    rows = [(i, f"http://a/{i}", h, "0" * 64, None) for i, h in enumerate(html)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                                       names=["page", "url", "html", "digest", "least"])
    out = list(W._write([batch], folder=str(tmp_path), roll=3 << 20))[0].to_pydict()
    assert len(out["path"]) >= 3 and sum(out["records"]) == len(rows)
    assert len(trained) == len(out["path"]) and min(trained[:-1]) >= W.TRAIN_BYTES
