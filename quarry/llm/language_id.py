"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in windows of ``WINDOW``; in each a forward and a backward recurrent layer
(update and reset gates, ``HIDDEN`` units) pass over the bytes, and a softmax over both states labels every
position. A document's probabilities are the mean of those of all its positions, over the whole text; the
prediction is the largest, its probability the score. Nothing but the bytes is an input.

Training is backpropagation through time in NumPy with Adam on a bounded sample: ``DOCUMENTS`` documents of each
language by a hash of the id, ``PLACES`` windows of each; every position of a window has its document's language
as target. Seeds are fixed, so the same rows give the same network.

Prediction runs where the texts are: windows of a batch are lanes of one matrix, sorted by length, so memory is
bounded by ``LANES`` windows whatever the texts' length.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled document
everything is ``und``; null ids are kept but not learnt from; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written
from quarry.llm.shingles import buffers

WINDOW, HIDDEN, LANES = 128, 8, 4096
DOCUMENTS, PLACES, STEPS, BATCH, RATE, SEED = 400, 4, 250, 128, 0.02, 7
MAX_SENT = 10_000
UND = "und"


def start(languages: int, hidden: int = HIDDEN, seed: int = SEED) -> dict:
    """Random parameters; per direction and gate (update, reset, candidate) a table of the bytes' inputs and a matrix
    of the state's."""
    r = np.random.default_rng(seed)
    p = {"out": r.normal(0, 0.3, (2 * hidden, languages)), "bias": np.zeros(languages)}
    for d in "fb":
        p[f"in_{d}"] = r.normal(0, 0.5, (3, 256, hidden))
        p[f"rec_{d}"] = r.normal(0, 1 / np.sqrt(hidden), (3, hidden, hidden))
    return {k: v.astype(np.float32) for k, v in p.items()}


def squash(x):
    """x / (1 + |x|): the network's bounded function, made of cheap array operations; gates use its half above 1/2."""
    return x / (1 + np.abs(x))


def cell(table, rec, x, h):
    """One step: new state, and what the way back needs. Update gate z, reset gate r, candidate c."""
    uz, ur, c = (squash(table[0][x] + h @ rec[0]), squash(table[1][x] + h @ rec[1]), None)
    z, r, s = 0.5 + 0.5 * uz, 0.5 + 0.5 * ur, h @ rec[2]
    c = squash(table[2][x] + r * s)
    return h + z * (c - h), (uz, ur, z, r, c, s)


def gradients(p: dict, x: np.ndarray, y: np.ndarray):
    """Loss and gradients for windows ``x`` (lanes x time) of languages ``y``: forward in both directions, then back
    through time."""
    lanes, steps = x.shape
    n = p["rec_f"].shape[1]
    kind = p["out"].dtype
    ways = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    states, kept = {}, {}
    for d, way in ways.items():
        h = np.zeros((lanes, n), kind)
        states[d], kept[d] = np.empty((steps, lanes, n), kind), {}
        for t in way:
            before = h
            h, parts = cell(p[f"in_{d}"], p[f"rec_{d}"], x[:, t], h)
            kept[d][t] = (before, *parts)
            states[d][t] = h
    both = np.concatenate([states["f"], states["b"]], 2)
    logits = both @ p["out"] + p["bias"]
    logits -= logits.max(2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(2, keepdims=True)
    loss = -np.log(np.maximum(prob[:, np.arange(lanes), y], 1e-9)).mean()
    prob[:, np.arange(lanes), y] -= 1
    prob /= steps * lanes
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["out"] = both.reshape(-1, 2 * n).T @ prob.reshape(steps * lanes, -1)
    grad["bias"] = prob.sum((0, 1))
    to = prob @ p["out"].T
    for i, (d, way) in enumerate(ways.items()):
        rec, dh = p[f"rec_{d}"], np.zeros((lanes, n), kind)
        inputs = np.empty((3, steps, lanes, n), kind)
        for t in reversed(way):
            h, uz, ur, z, r, c, s = kept[d][t]
            dh = dh + to[t, :, i * n:(i + 1) * n]
            dc = dh * z * (1 - np.abs(c)) ** 2
            dz = dh * (c - h) * (0.5 * (1 - np.abs(uz)) ** 2)
            dr = dc * s * (0.5 * (1 - np.abs(ur)) ** 2)
            inputs[0, t], inputs[1, t], inputs[2, t] = dz, dr, dc
            ds = dc * r
            for gate, g in enumerate((dz, dr, ds)):
                grad[f"rec_{d}"][gate] += h.T @ g
            dh = dh * (1 - z) + dz @ rec[0].T + dr @ rec[1].T + ds @ rec[2].T
        order = np.argsort(x.T.ravel(), kind="stable")
        seen, first = np.unique(x.T.ravel()[order], return_index=True)
        for gate in range(3):
            grad[f"in_{d}"][gate][seen] = np.add.reduceat(inputs[gate].reshape(-1, n)[order], first)
    return loss, grad


def train(windows: np.ndarray, targets: np.ndarray, languages: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE,
          seed: int = SEED) -> dict:
    """Adam with a falling rate over random batches that hold the languages evenly."""
    rng = np.random.default_rng(seed)
    p = start(languages, seed=seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    share = 1 / np.bincount(targets, minlength=languages)[targets]
    share /= share.sum()
    for i in range(1, steps + 1):
        pick = rng.choice(len(windows), batch, p=share)
        _, g = gradients(p, windows[pick], targets[pick])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        pace = rate * (1 - 0.9 * i / steps)
        for k in p:
            x = g[k] * min(1.0, 1 / max(size, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            p[k] -= (pace * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.999 ** i)) + 1e-8)).astype(np.float32)
    return p


class Steps:
    """A direction's steps for prediction, on arrays that are reused."""

    def __init__(self, table, rec, lanes):
        self.table, self.rec = table, [np.ascontiguousarray(m) for m in rec]
        self.buffers = [np.empty((lanes, rec.shape[1]), np.float32) for _ in range(4)]

    def gate(self, k, x, h, a, b):
        """Leaves the gate's input in ``a`` and squashes it there; ``b`` is scratch."""
        np.take(self.table[k], x, axis=0, out=a, mode="clip")
        np.matmul(h, self.rec[k], out=b)
        a += b
        self.squash(a, b)

    @staticmethod
    def squash(a, b):
        np.abs(a, out=b)
        b += 1
        a /= b

    def step(self, x, h):
        """Moves the state ``h`` on by the bytes ``x``."""
        z, r, c, b = (m[:len(x)] for m in self.buffers)
        self.gate(0, x, h, z, b)
        self.gate(1, x, h, r, b)
        for g in (z, r):
            g *= 0.5
            g += 0.5
        np.take(self.table[2], x, axis=0, out=c, mode="clip")
        np.matmul(h, self.rec[2], out=b)
        b *= r
        c += b
        self.squash(c, b)
        c -= h
        c *= z
        h += c


def label(p: dict, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over positions of the language probabilities of the windows ``data[begin:begin + size]``."""
    out = np.zeros((len(begin), len(p["bias"])), np.float32)
    n, order = p["rec_f"].shape[1], np.argsort(-size, kind="stable")
    width = min(LANES, len(order))
    ahead, back = (Steps(p[f"in_{d}"], p[f"rec_{d}"], width) for d in "fb")
    out_f, out_b, ones = p["out"][:n].copy(), p["out"][n:].copy(), np.ones((out.shape[1],) * 2, np.float32)
    forward = np.empty((WINDOW, width, n), np.float32)
    e, f = (np.empty((width, out.shape[1]), np.float32) for _ in range(2))
    for c in range(0, len(order), LANES):
        lanes = order[c:c + LANES]
        longest = int(size[lanes[0]])
        live = np.searchsorted(-size[lanes], -np.arange(longest), side="left")  # lanes longer than t
        at = np.minimum(begin[lanes] + np.arange(longest)[:, None], len(data) - 1)
        x = data[at].astype(np.intp)
        h = np.zeros((len(lanes), n), np.float32)
        for t in range(longest):
            k = live[t]
            ahead.step(x[t, :k], h[:k])
            forward[t, :k] = h[:k]
        total = np.zeros((len(lanes), out.shape[1]), np.float32)
        h[:] = 0
        for t in range(longest - 1, -1, -1):
            k = live[t]
            back.step(x[t, :k], h[:k])
            np.matmul(forward[t, :k], out_f, out=e[:k])
            np.matmul(h[:k], out_b, out=f[:k])
            e[:k] += f[:k]
            e[:k] += p["bias"]
            np.clip(e[:k], -60, 60, out=e[:k])
            np.exp(e[:k], out=e[:k])
            np.matmul(e[:k], ones, out=f[:k])
            e[:k] /= f[:k]
            total[:k] += e[:k]
        out[lanes] = total
    return out


def probabilities(p: dict, column) -> np.ndarray:
    """Pooled language probabilities of each row of an Arrow text column (rows of zeros for empty texts)."""
    data, off = buffers(column)
    length = np.diff(off)
    windows = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), windows)
    begin = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    size = np.minimum(WINDOW, off[1:][row] - begin)
    sums = label(p, data, begin, size)
    out = np.stack([np.bincount(row, sums[:, k], len(length)) for k in range(sums.shape[1])], 1) if len(row) else np.zeros((len(length), sums.shape[1]))
    return out / np.maximum(length, 1)[:, None]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, documents: int = DOCUMENTS, places: int = PLACES):
    """``(windows, targets, languages)`` of a bounded sample of labelled documents (module docstring)."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    counts = written(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")), "languages")
    counts = F.broadcast(counts) if counts.count() <= MAX_SENT else counts  # a row per language
    parts = F.array(*[F.substring(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(j)), F.greatest(
        F.length(text_col) - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for j in range(places)])
    some = rows.select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col), F.col(id_col)).join(counts, "lang")
    # a hash threshold leaves about twice as many as are taken, whatever the size of a language
    few = F.pmod("key", F.lit(1 << 31)) < F.least(F.lit(1.0), F.lit(2.0 * documents) / F.col("n")) * (1 << 31)
    some = some.where(few).select("key", "lang", parts.alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "parts"))
    got = some.withColumn("rank", rank).where(F.col("rank") <= documents).select("lang", "parts").toArrow()
    pairs = sorted((a, part.encode()[:WINDOW]) for a, ps in zip(got.column(0).to_pylist(), got.column(1).to_pylist()) for part in ps)
    languages = sorted({a for a, _ in pairs})
    windows = np.full((len(pairs), WINDOW), 32, np.uint8)  # shorter ones end in spaces
    for i, (_, raw) in enumerate(pairs):
        windows[i, :len(raw)] = np.frombuffer(raw, np.uint8)
    return windows, np.array([languages.index(a) for a, _ in pairs], np.int64), languages


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> dict:
    """A network fitted on labelled documents: parameters and ``languages``."""
    windows, targets, languages = sample(docs, id_col, text_col, lang_col)
    return {"languages": languages, **(train(windows, targets, len(languages), **kw) if languages else {})}


def _predicted(batches, model):
    p = model.value
    names = np.array([*p["languages"], UND], object)
    for b in batches:
        if p["languages"]:
            prob = probabilities(p, b.column(1))
            best = prob.argmax(1)
            some = np.asarray(b.column(2)) & (prob.sum(1) > 0)
            pick, score = np.where(some, best, len(names) - 1), np.where(some, prob.max(1), 0.0)
        else:
            pick, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pick], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))],
                                         names=["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, ``lang_pred``, ``score``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), text.rlike(r"\p{L}").alias("_letters"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return (rows.mapInArrow(functools.partial(_predicted, model=sent),
                            f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: id, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score")
