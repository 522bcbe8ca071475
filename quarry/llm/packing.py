"""Packing along a space-filling curve.

Every document becomes its token ids and an end id. Its vector is the hashed bag of its ids projected to
``DIMS`` random directions (a fixed table per id: hash, sign and size, so no vocabulary must be fitted); the
coordinates are scaled by their mean and deviation over all documents and give a Hilbert key of ``DIMS * BITS``
bits. Documents are range-sorted by (key, id, row) and laid end to end along the curve: a running sum in two
steps (within range partitions, then over the partitions' totals, one row each) gives every document its place,
and sequence boundaries lie at every multiple of ``size``. Neighbours on the curve share sequences, each
id lies in one piece, and only the last sequence can fall short.

The sort moves keys, not ids: ids are written once and meet their place by the row's number. Texts are encoded
by parts between spaces and line feeds, across which no token of a lower-casing, white-space-dropping pre-tokenizer
reaches; each task's Python process remembers the ids of parts (at most ``MEMORY``, about 200 bytes each) so that a repeated word is
encoded once. Any other vocabulary encodes texts whole.

Defined results: null text is empty and has only its end id; each input row is a document, repeated rows
included; null ids sort first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written
from quarry.llm.shingles import U, mix

SIZE, END, DIMS, BITS, MEMORY = 4096, 2, 4, 8, 1_500_000


def directions(n: int) -> np.ndarray:
    """``n x DIMS`` normal numbers, a fixed function of id and direction."""
    h = mix(np.arange(n * DIMS * 2, dtype=U) + U(0x51ED270B))
    u = ((h >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
    u = u.reshape(n, DIMS, 2)
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


@functools.lru_cache(maxsize=2)
def load(path: str):
    """``(tokenizer, id type, directions, memory or None)``."""
    import json
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    drops = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    free = drops and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True \
        and all(" " not in t["content"] and "\n" not in t["content"] for t in spec["added_tokens"])
    n = tok.get_vocab_size(with_added_tokens=True)
    return tok, np.dtype(np.uint16 if n <= 65536 else np.uint32), directions(n), {} if free else None


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian ids of each text, as bytes of the vocabulary's id type."""
    tok, kind, _, memory = load(path)
    plain = lambda xs: [array(kind.char, e.ids).tobytes() for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
    if memory is None:
        return plain(texts)
    most = MEMORY // 4
    rows = [t.replace("\n", " ").split(" ") for t in texts]
    out: list = [[] for _ in texts]
    begin, left = 0, [(i, at) for i, r in enumerate(rows) for at in range(0, len(r), most)]  # a text of any length
    while begin < len(left):
        end, held = begin, 0
        while end < len(left) and (end == begin or held < most):  # pieces whose new parts are encoded in one call
            held += min(most, len(rows[left[end][0]]) - left[end][1])
            end += 1
        pieces = [(i, rows[i][at:at + most]) for i, at in left[begin:end]]
        new = {p for _, piece in pieces for p in piece if p not in memory}
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = {p for _, piece in pieces for p in piece}
        if new:
            new = list(new)
            memory.update(zip(new, plain(new)))
        for i, piece in pieces:
            out[i].append(b"".join([memory[p] for p in piece]))
        begin = end
    return [b"".join(x) for x in out]


def _documents(batches, path, end):
    """Rows ``(id, n, ids, v0..)``: tokens with the end id, and the mean of their directions."""
    _, kind, table, _ = load(path)
    last = np.array([end], kind).tobytes()
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            ids = [x + last for x in encode(part.column(1).to_pylist(), path)]
            flat = np.frombuffer(b"".join(ids), kind)
            n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
            begin = np.cumsum(n) - n
            v = np.stack([np.add.reduceat(table[flat, d], begin) for d in range(DIMS)]) / n
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids, pa.binary()), *[pa.array(x) for x in v]],
                                             names=["id", "n", "ids", *[f"v{d}" for d in range(DIMS)]])


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points ``x`` (n x dims, each below ``2**bits``): the axes are
    turned into the transposed index bit plane by bit plane, then the planes are interleaved."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] = np.where(high, x[:, 0] ^ (q - 1), x[:, 0] ^ swap)
            x[:, d] ^= swap if d else 0
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    t, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def _keys(batches, mean, deviation):
    """``(uid, id, n, key)``: coordinates in half deviations around the mean, three deviations to each side."""
    for b in batches:
        v = np.stack([b.column(3 + d).to_numpy() for d in range(DIMS)], 1)
        cell = np.clip(((v - mean) / deviation + 3) / 6, 0, 1 - 1e-9) * (1 << BITS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hilbert(cell.astype(np.int64), BITS))],
                                         names=["uid", "id", "n", "key"])


def _pieces(batches, size, width, with_ids):
    """From ``(id, n, ids, at)``: the pieces of each document."""
    kind = np.dtype(np.uint16 if width == 2 else np.uint32)
    for b in batches:
        n, at = b.column(1).to_numpy(), b.column(3).to_numpy()
        first, last = at // size, (at + n - 1) // size
        count = last - first + 1
        row = np.repeat(np.arange(len(n)), count)
        seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.maximum(seq * size, at[row])
        stop = np.minimum((seq + 1) * size, at[row] + n[row])
        start, length = begin - at[row], stop - begin
        crc, ids, now, held = [], [], -1, None
        for r, s, k in zip(row.tolist(), start.tolist(), length.tolist()):
            if r != now:
                now, held = r, np.frombuffer(b.column(2)[r].as_py(), kind).astype("<u4").tobytes()
            part = held[4 * s:4 * (s + k)]
            crc.append(zlib.crc32(part))
            if with_ids:
                ids.append(part)
        cols = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq),
                pa.array(begin - seq * size)]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END,
         with_ids: bool = False) -> DataFrame:
    """A row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and the
    piece's ids as little-endian unsigned 32-bit numbers)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    axes = [f"v{d}" for d in range(DIMS)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tokens = rows.mapInArrow(functools.partial(_documents, path=path, end=end),
                             f"id {id_type}, n long, ids binary, " + ", ".join(f"{v} double" for v in axes))
    tokens = written(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    stats = tokens.agg(*[f(v) for v in axes for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([x or 0.0 for x in stats[0::2]])
    deviation = np.array([x or 1.0 for x in stats[1::2]])
    keys = tokens.select("uid", "id", "n", *axes).mapInArrow(functools.partial(_keys, mean=mean, deviation=deviation),
                                                            f"uid long, id {id_type}, n long, key long")
    line = ["key", "id", "uid"]
    dealt = written(keys.repartitionByRange(*line).withColumn("part", F.spark_partition_id()), "curve")
    local = Window.partitionBy("part").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    offsets = dealt.groupBy("part").agg(F.sum("n").alias("sum"))
    offsets = offsets.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    places = (dealt.withColumn("local", F.coalesce(F.sum("n").over(local), F.lit(0))).join(offsets, "part")
              .select("uid", (F.col("base") + F.col("local")).alias("at")))
    joined = tokens.select("uid", "id", "n", "ids").join(places, "uid").select("id", "n", "ids", "at")
    width = load(path)[1].itemsize
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = joined.mapInArrow(functools.partial(_pieces, size=size, width=width, with_ids=with_ids), schema + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)
