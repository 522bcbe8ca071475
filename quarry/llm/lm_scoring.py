"""Language-model scores of documents from a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the two tokens before it times that of the token in its class.
The most frequent training tokens (``SLOTS`` a class, by rank, ``HEAD`` classes; each at least 2^-20 of all) have a second softmax over
their class's slots; all other tokens lie in one of ``TAIL`` classes by the CRC-32 of their last two bytes, where
training counts alone decide: (c + 0.1) / (N_k + 0.1 (V_k + 1)), an unknown token counting as the one unseen. Both
softmaxes start from the classes' and tokens' training counts and add weights of three hashed features: the token
before, the one before that (a skip feature), and both together. Probabilities of all known tokens and the unseen
ones add up to one, so ``score``, the sum of log10 over a text's tokens, is a log probability.

Counting: tasks count words and the counts are summed by word. A word with at least 2^-20 of all tokens is known
in every task (at most 2^20 such words whatever the corpus, normally far fewer), the others' counts are joined by
word: none of them is frequent enough to make a hot key.

Training: one pass over all training documents in two rounds (a keyed eighth, then the rest). In a round every
trainer starts from the same weights, makes gradient updates (AdaGrad, a step size per row) on its documents in
batches of ``BATCH`` tokens, and returns what it changed; changes are averaged by row, weighted by how often a trainer
met the row. Weights, all that the driver gathers here, have a fixed size (10 MB). There are at most two trainers a
core, each over several input splits, so what they exchange doesn't grow with the number of splits.

Scoring: numpy batches over many documents; a text's words outside the tasks' dictionary leave as (word, count) rows
and come back as one sum per document.

Defined results: null text is empty and has the end token alone; a document with a null ``doc_id`` is not held
out; repeated rows are scored (and learnt from) each; a text of any length is taken
whole, in pieces of ``PIECE`` bytes cut at white space; without training documents every token is unknown; an empty
table gives an empty result; other columns are ignored. Weights depend in their last digits, not in kind, on how Spark
deals the documents to trainers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import written

BASE = 0.1
HEAD, SLOTS, TAIL = 16, 64, 16
CLASSES = HEAD + TAIL
WORDS = HEAD * SLOTS
CONTEXTS = WORDS + TAIL + 1
START = CONTEXTS - 1
ROWS1, ROWS2, BLOCK = 1 << 14, 1 << 15, 256
KNOWN_SHARE = 1 << 20
BATCH, GATHER, PIECE, DISTINCT, TAIL_ROWS = 4096, 1 << 16, 1 << 22, 1 << 20, 1 << 16
RATE, FIRST_ROUND = 0.5, 8
END = b""
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(raw: bytes):
    """Lists of a text's lower-cased words, a piece at a time."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def tail_class(word: bytes) -> int:
    return crc32(word[-2:]) % TAIL


def _texts(batch):
    import pyarrow as pa
    return batch.column("text").cast(pa.binary()).to_pylist()


# ---- counts

def _count(batches):
    import pyarrow as pa
    names = ["token", "n_train", "n_held"]

    def flush():
        train, held = counts
        every = list(train.keys() | held.keys())
        for k in range(0, len(every), 1 << 16):
            part = every[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([train[w] for w in part], pa.int64()),
                                              pa.array([held[w] for w in part], pa.int64())], names=names)

    counts = (Counter(), Counter())
    for b in batches:
        for raw, out in zip(_texts(b), b.column("held_out").to_pylist()):
            for words in words_of(raw):
                counts[out].update(words)
            counts[out][END] += 1
            if len(counts[0]) + len(counts[1]) > DISTINCT:
                yield from flush()
                counts = (Counter(), Counter())
    yield from flush()


class Vocabulary:
    """Counts of all tokens as a table; the frequent ones, the model's classes and the totals as arrays."""

    def __init__(self, docs: DataFrame, known_share: int = KNOWN_SHARE):
        counted = docs.select("text", "held_out").mapInArrow(_count, "token binary, n_train long, n_held long")
        counts = counted.groupBy("token").agg(F.sum("n_train").alias("n_train"), F.sum("n_held").alias("n_held"))
        self.counts = written(counts, "lm-counts")
        k = (F.crc32(F.substring("token", -2, 2)) % TAIL).cast("int")
        known = F.when(F.col("n_train") > 0, 1).otherwise(0)
        by_class = (self.counts.groupBy(k.alias("k")).agg(F.sum("n_train").alias("n"), F.sum(known).alias("v"),
                                                          F.sum(F.col("n_train") + F.col("n_held")).alias("every")).collect())
        self.n, self.v, every = (sum(r[c] for r in by_class) for c in ("n", "v", "every"))
        mass, sizes = np.zeros(TAIL), np.zeros(TAIL)
        for r in by_class:
            mass[r["k"]], sizes[r["k"]] = r["n"], r["v"]
        self.least = -(-every // known_share)
        frequent = self.counts.where((F.col("n_train") + F.col("n_held") >= self.least) | (F.length("token") == 0)).collect()
        frequent.sort(key=lambda r: (len(r["token"]) > 0 or r["n_train"] == 0, -r["n_train"], bytes(r["token"])))
        self.words = [bytes(r["token"]) for r in frequent]
        c = np.array([r["n_train"] for r in frequent], dtype=np.float64)
        self.model = min(WORDS, int((c > 0).sum()))
        ids = np.arange(len(c))
        tails = np.array([tail_class(w) for w in self.words], dtype=np.int32)
        inside = ids < self.model
        np.subtract.at(mass, tails[inside], c[inside])
        np.subtract.at(sizes, tails[inside], 1)
        # Tables by id, after one place per tail class for words outside: id -1 - k is a word of tail class k.
        outside = np.arange(TAIL)[::-1]
        self.classes = np.concatenate([HEAD + outside, np.where(inside, ids // SLOTS, HEAD + tails)]).astype(np.int32)
        self.slots = np.concatenate([np.full(TAIL, -1), np.where(inside, ids % SLOTS, -1)]).astype(np.int32)
        self.contexts = np.concatenate([WORDS + outside, np.where(inside, ids, WORDS + tails)]).astype(np.uint32)
        self.log_count = np.concatenate([np.zeros(TAIL), np.log10(c + BASE)])
        self.known = np.concatenate([np.zeros(TAIL, dtype=np.int64), (c > 0).astype(np.int64)])
        norm = mass + BASE * (sizes + 1)
        self.log_norm = np.log10(norm)
        never = -1e4
        self.bias2 = np.full((HEAD, SLOTS), never, dtype=np.float32)
        with np.errstate(divide="ignore"):
            self.bias2.ravel()[:self.model] = np.log(c[:self.model])
            heads = np.array([c[:self.model][k * SLOTS:(k + 1) * SLOTS].sum() for k in range(HEAD)])
            self.bias1 = np.maximum(np.log(np.concatenate([heads, norm])), never).astype(np.float32)

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "counts"}

    def log_all(self) -> float:
        return math.log10(self.n + BASE * (self.v + 1))


class _Ids(dict):
    """Ids of the frequent words; other words give their tail class."""

    def __missing__(self, word):
        return -1 - tail_class(word)


def _tokens(texts, ids, tail: bool = False):
    """``(id arrays, tail words)`` of texts, each with its end."""
    for raw in texts:
        found, rare = [], Counter()
        for words in words_of(raw):
            here = list(map(ids.__getitem__, words))
            if tail:
                rare.update([w for w, i in zip(words, here) if i < 0])
            found.append(np.array(here, dtype=np.int32))
        found.append(np.array([ids[END]], dtype=np.int32))
        yield np.concatenate(found), rare


# ---- the model

def _hashed(*parts, rows: int, base: int = 0):
    h = np.zeros(len(parts[0]), dtype=np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(rows - base) + np.uint32(base)).astype(np.uint16)


class _Positions:
    """Classes, slots and feature rows of all positions of some texts."""

    def __init__(self, arrays: list, v):
        ids = np.concatenate(arrays) + TAIL
        starts = np.cumsum([0] + [len(a) for a in arrays])[:-1]
        ctx = v.contexts[ids]
        before = np.empty_like(ctx)
        before[1:] = ctx[:-1]
        before[starts] = START
        earlier = np.empty_like(before)
        earlier[1:] = before[:-1]
        earlier[starts] = START
        self.ids, self.starts = ids, starts
        self.classes, self.slots = v.classes[ids], v.slots[ids]
        self.rows1 = [before.astype(np.uint16), (earlier + CONTEXTS).astype(np.uint16),
                      _hashed(before, earlier, rows=ROWS1, base=2 * CONTEXTS)]
        self.inner = np.flatnonzero(self.slots >= 0)
        c, b, e = self.classes[self.inner].astype(np.uint32), before[self.inner], earlier[self.inner]
        self.rows2 = [_hashed(c, b, rows=ROWS2), _hashed(c + np.uint32(HEAD), e, rows=ROWS2), _hashed(c, b, e, rows=ROWS2)]


def _softmax(bias, table, rows):
    """Probabilities of a batch's outcomes."""
    z = table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_probabilities(table, bias, rows, target, out):
    for k in range(0, len(target), BATCH):
        s = slice(k, k + BATCH)
        p = _softmax(bias if bias.ndim == 1 else bias[s], table, [r[s] for r in rows])
        out[s] = np.log(np.maximum(p[np.arange(len(p)), target[s]], 1e-30))


class _Learner:
    """A table of weights under AdaGrad with a step size per row."""

    def __init__(self, table):
        self.table, self.old = table.copy(), table
        self.squares, self.met = np.full(len(table), 1.0, dtype=np.float32), np.zeros(len(table), dtype=np.int64)

    def update(self, bias, rows, target):
        e = _softmax(bias, self.table, rows)
        n = len(target)
        e[np.arange(n), target] -= 1
        r = np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        u = sorted_rows[starts]
        g = np.add.reduceat(e.view(np.complex64)[order % n], starts, axis=0).view(np.float32)  # two sums at a time
        self.met[u] += np.diff(np.append(starts, len(r)))
        self.squares[u] += np.einsum("ij,ij->i", g, g)
        self.table[u] -= (RATE / np.sqrt(self.squares[u]))[:, None] * g

    def changes(self, name: int):
        """``(table, block, changes times meetings, meetings)`` of the blocks that were met."""
        for k in range(0, len(self.met), BLOCK):
            met = self.met[k:k + BLOCK]
            if met.any():
                d = (self.table[k:k + BLOCK] - self.old[k:k + BLOCK]) * met[:, None]
                yield name * ROWS2 + k, d.astype("<f4").tobytes(), met.astype("<i8").tobytes()


def _train(model):
    def run(batches):
        import pyarrow as pa
        v, tables = model.value
        ids = _Ids(zip(v.words, range(len(v.words))))
        one, two = _Learner(tables[0]), _Learner(tables[1])

        def learn(arrays):
            p = _Positions(arrays, v)
            for k in range(0, len(p.ids), BATCH):
                s = slice(k, k + BATCH)
                one.update(v.bias1, [r[s] for r in p.rows1], p.classes[s])
            target, bias = p.slots[p.inner], v.bias2[p.classes[p.inner]]
            for k in range(0, len(target), BATCH):
                s = slice(k, k + BATCH)
                two.update(bias[s], [r[s] for r in p.rows2], target[s])

        held, size = [], 0
        for b in batches:
            for found, _ in _tokens(_texts(b), ids):
                for k in range(0, len(found), GATHER):  # a very long text goes in several gathers
                    held.append(found[k:k + GATHER])
                    size += len(held[-1])
                    if size >= GATHER:
                        learn(held)
                        held, size = [], 0
        if held:
            learn(held)
        for name, learner in ((0, one), (1, two)):
            for block, d, met in learner.changes(name):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([d], pa.binary()), pa.array([met], pa.binary())],
                                                 names=["block", "changes", "met"])
    return run


def _sum_blocks(batches):
    import pyarrow as pa
    sums: dict = {}
    for b in batches:
        for block, d, met in zip(*(b.column(c).to_pylist() for c in ("block", "changes", "met"))):
            d, met = np.frombuffer(d, "<f4").astype(np.float64), np.frombuffer(met, "<i8")
            old = sums.get(block)
            sums[block] = (d, met) if old is None else (old[0] + d, old[1] + met)
    for block, (d, met) in sorted(sums.items()):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([d.tobytes()], pa.binary()),
                                          pa.array([met.astype("<i8").tobytes()], pa.binary())], names=["block", "changes", "met"])


SENT = "block int, changes binary, met binary"


def train(docs: DataFrame, v: Vocabulary) -> list:
    """The two tables of weights after both rounds."""
    sc = docs.sparkSession.sparkContext
    tables = [np.zeros((ROWS1, CLASSES), dtype=np.float32), np.zeros((ROWS2, SLOTS), dtype=np.float32)]
    share = F.crc32(F.concat(F.lit("round:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % FIRST_ROUND
    for chosen in (share == 0, share != 0):
        model = sc.broadcast((v, tables))
        sent = docs.where(~F.col("held_out") & chosen).select("text").coalesce(2 * sc.defaultParallelism).mapInArrow(_train(model), SENT)
        new = [t.copy() for t in tables]
        for row in sent.repartition("block").mapInArrow(_sum_blocks, SENT).collect():
            d, met = np.frombuffer(row["changes"], "<f8").reshape(BLOCK, -1), np.frombuffer(row["met"], "<i8")
            name, k = divmod(row["block"], ROWS2)
            new[name][k:k + BLOCK] += (d / np.maximum(met, 1)[:, None]).astype(np.float32)
        tables = new
        model.unpersist()
    return tables


# ---- scores

def log10_inside(v: Vocabulary, tables: list, arrays: list) -> tuple:
    """Per position the part of log10 P that needs no counts from elsewhere, and the positions."""
    p = _Positions(arrays, v)
    outer = np.zeros(len(p.ids))
    _log_probabilities(tables[0], v.bias1, p.rows1, p.classes, outer)
    inner = np.zeros(len(p.inner))
    c = p.classes[p.inner]
    _log_probabilities(tables[1], v.bias2[c], p.rows2, p.slots[p.inner], inner)
    outer[p.inner] += inner
    outer /= math.log(10)
    tail = p.slots < 0
    outer[tail] += v.log_count[p.ids[tail]] - v.log_norm[p.classes[tail] - HEAD]
    return outer, p


def _score(model, names: list, id_type):
    def run(batches):
        import pyarrow as pa
        v, tables = model.value
        ids = _Ids(zip(v.words, range(len(v.words))))
        types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

        def sent(docs, sums):
            """A row per document; words beyond the first ``TAIL_ROWS`` follow in rows of their own."""
            cols: list = [[] for _ in names]
            for (key, doc_id, held_out, found, rare), (inside, count, known) in zip(docs, sums):
                rare = list(rare.items())
                row = (key, doc_id, held_out, len(found), int(known), float(inside), float(count))
                for k in range(0, max(len(rare), 1), TAIL_ROWS):
                    part = rare[k:k + TAIL_ROWS]
                    for c, x in zip(cols, (*row, [w for w, _ in part], [n for _, n in part])):
                        c.append(x)
                    row = (key, None, None, 0, 0, 0.0, 0.0)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def several(docs):
            logs, p = log10_inside(v, tables, [d[3] for d in docs])
            return sent(docs, zip(*(np.add.reduceat(x, p.starts) for x in (logs, v.log_count[p.ids], v.known[p.ids]))))

        def long_one(doc):
            """Windows that overlap by the two tokens of context."""
            found, total = doc[3], np.zeros(3)
            for k in range(0, len(found), GATHER):
                at = max(k - 2, 0)
                logs, p = log10_inside(v, tables, [found[at:k + GATHER]])
                total += [x[k - at:].sum() for x in (logs, v.log_count[p.ids], v.known[p.ids])]
            return sent([doc], [(total[0], total[1], total[2])])

        held, size = [], 0
        for b in batches:
            about = zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "held_out")))
            for row, (found, rare) in zip(about, _tokens(_texts(b), ids, tail=True)):
                if len(found) > GATHER:
                    yield long_one((*row, found, rare))
                    continue
                held.append((*row, found, rare))
                size += len(found)
                if size >= GATHER:
                    yield several(held)
                    held, size = [], 0
        if held:
            yield several(held)
    return run


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_share: int = KNOWN_SHARE) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per document."""
    from pyspark.sql.pandas.types import to_arrow_type
    sc = documents.sparkSession.sparkContext
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))
    v = Vocabulary(docs, known_share)
    model = sc.broadcast((v, train(docs, v)))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("inside", T.DoubleType()), T.StructField("log_count", T.DoubleType()),
                           T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    parts = written(keyed.mapInArrow(_score(model, schema.names, to_arrow_type(id_type)), schema), "lm-parts")
    rare = parts.select("key", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    few = v.counts.where((F.col("n_train") + F.col("n_held") < v.least) & (F.length("token") > 0)).select("token", "n_train")
    logs = F.col("w.counts") * F.log10(F.col("n_train") + BASE)
    from_counts = rare.join(few, F.col("w.words") == F.col("token")).select(
        "key", F.when(F.col("n_train") > 0, F.col("w.counts")).otherwise(0).alias("n_known"), logs.alias("log_count"), logs.alias("inside"))
    own = parts.select("key", "doc_id", "held_out", "n_tokens", "n_known", "log_count", "inside")
    whole = own.unionByName(from_counts, allowMissingColumns=True).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("log_count").alias("log_count"), F.sum("inside").alias("score"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"),
                        (F.col("log_count") - F.col("n_tokens") * F.lit(v.log_all())).alias("base_score"), "score")
