"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, A-Z lower-cased. Passages are stretches of ``WINDOW`` words at half their
step over whole documents.

1. Document frequencies of hashed words (``2**BITS`` features) are counted over all documents.
2. A randomised SVD of the TF-IDF matrix of all benchmark items and all passages (the documents' whole texts cut into
   consecutive passages; columns are the words that an item has) gives ``RANK`` latent directions: with ``C`` the product
   of the matrix with itself and ``S`` a random sketch, ``C S`` is summed in the pass that counts the document
   frequencies (the sketch is divided by the weights, so that they aren't needed there), and ``C S (S' C S)^-1 S' C`` has the
   directions. Together the passages weigh as ``MASS`` items, or as ``WEIGHT`` items a document where that is less. Sums
   are Spark's; the driver gets a row of fixed size for each of the items' features, at most ``2**BITS``.
3. Every passage of every document is folded in. Its score with an item is the inner product of the passage's
   latent vector and the item's latent direction over the length of the passage's idf weights, so that words
   outside the latent space count against it. An item longer than ``PART`` words is searched by its parts. What a true
   copy can score depends on the item: with more items than directions only a share ``own`` of its vector lies in the
   latent space, and a part of ``n`` words fills a passage of ``WINDOW`` only so far. The cut of a part is therefore
   ``own * sqrt(min(n, WINDOW) / max(n, WINDOW))`` times ``FLOOR``, and at most ``COSINE``. Scores from the cut on are
   candidates; there is no limit to their number.
   So that no leak depends on a cut, every stretch whose words allow a leak is a candidate too, whatever its score
   (``word_search``; without it the latent search stands alone, with measured recall): a leak holds ``need``
   of the item's ``n`` words (``LOOSE``, short items all) within 1.25 times its length, and thus at least
   ``need - (n - p)`` of any ``p`` of them. The ``p`` rarest are looked up; ``p`` only decides how much is looked up
   and checked, no leak is lost by it.
4. A candidate is checked on words: around the passage, stretches of 1.25 times the item's length are aligned by
   longest common subsequence. It is a leak if the subsequence has at least ``SHARE`` of the item's words, or at
   least ``LOOSE`` of them while the item's answer stands there word for word. The answer is the benchmark's answer
   column or, without one, the item's last ``ANSWER`` words. Items below ``SHORT`` words must be there whole.

Items are taken in blocks of at most ``BLOCK`` by a hash, so that what is sent to the tasks is bounded; documents
are never shuffled.

Defined results: null or blank texts have no leaks; items without words are ignored; items with equal texts are
separate items; repeated documents are judged each by itself; null ids are kept; an empty benchmark or an empty
table gives no leaks; other columns are ignored by ``leaks`` and kept as they are by ``decontaminate``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.shingles import MARKS, U, buffers, mix, slices, word_hashes

WINDOW, BITS, RANK, EXTRA, MASS, WEIGHT, BLOCK = 32, 17, 128, 8, 205, 0.1, 4096
COSINE, SHARE, LOOSE, ANSWER, SHORT = 0.3, 0.8, 0.55, 8, 8
PART, FLOOR = 48, 0.4
STEP = WINDOW // 2
#: words met with items at a time
MEETINGS = 1 << 21


def documents_words(column):
    """Yields ``(row, word hashes)`` for the rows of an Arrow text column."""
    data, off = buffers(column)
    for i, j in slices(off):
        h, t, _ = word_hashes(data, off[i:j + 1], MARKS)
        cuts = np.searchsorted(t, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, h[cuts[r]:cuts[r + 1]]


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at].sum(1)`` for places ``at`` of two dimensions, without the rows side by side."""
    out = np.empty((len(at), table.shape[1]), table.dtype)
    more = np.empty((min(len(at), 512), table.shape[1]), table.dtype)
    for c in range(0, len(at), 512):
        cols, total = np.ascontiguousarray(at[c:c + 512].T), out[c:c + 512]
        np.take(table, cols[0], axis=0, out=total, mode="clip")
        for x in cols[1:]:
            total += np.take(table, x, axis=0, out=more[:len(total)], mode="clip")
    return out


def summed_by(rows: np.ndarray, at: np.ndarray, key: np.ndarray):
    """``(distinct keys, sums)`` of ``rows[at]`` by key, from at least one; the last of ``rows`` are zeros."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(begin, len(key)))
    parts = -(-many // 8)  # eight rows at a time
    first = np.cumsum(parts) - parts
    place = np.arange(len(key)) - np.repeat(begin, many)
    table = np.full((int(parts.sum()), 8), len(rows) - 1)
    table[np.repeat(first, many) + place // 8, place % 8] = at
    return key[begin], np.add.reduceat(row_sums(rows, table), first, axis=0)


def _features(batches):
    for b in batches:
        found = [feature(h) for _, h in documents_words(b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["f"])


def sketch(known: np.ndarray) -> np.ndarray:
    """The random row of each feature, and zeros at the end."""
    out = np.zeros((len(known) + 1, RANK + EXTRA), np.float32)
    for c in range(0, len(known), 4096):
        out[c:c + 4096][:len(known) - c] = normals(known[c:c + 4096], RANK + EXTRA)
    return out


def places(known: np.ndarray) -> np.ndarray:
    """The place of every feature in ``known``, or its length."""
    out = np.full(1 << BITS, len(known), np.int32)
    out[known] = np.arange(len(known))
    return out


def _counted(f, n, words, rows=None):
    """A batch of ``(f, n, words, row)``."""
    none = pa.nulls(len(f), pa.int64())
    lists = pa.nulls(len(f), pa.list_(pa.float64())) if rows is None else pa.ListArray.from_arrays(
        pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(f), none if n is None else pa.array(n), none if words is None else pa.array(words), lists],
                                      names=["f", "n", "words", "row"])


def _frequencies(batches, sent):
    """Per task: documents with each feature and its words, documents (feature -1), and for each of the items' features
    the sum over all passages of its words there times the passage's sketch."""
    known = sent.value
    place, random = places(known), sketch(known)
    total, words, docs, sums = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0, np.zeros((len(known), RANK + EXTRA))
    for b in batches:
        data, off = buffers(b.column(0))
        for i, j in slices(off):
            h, t, _ = word_hashes(data, off[i:j + 1], MARKS)
            f, bounds = feature(h), np.searchsorted(t, np.arange(j - i + 1))
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                total[f[a:z]] += 1  # once for a repeated feature
            words += np.bincount(f, minlength=len(words))
            docs += j - i
            n = np.diff(bounds)
            blocks = -(-n // WINDOW)
            if not len(known) or not len(h):
                continue
            # each text from a passage of its own; gaps and words of no item have the row of zeros
            x = np.full(int(blocks.sum()) * WINDOW, len(known))
            x[np.repeat((np.cumsum(blocks) - blocks) * WINDOW, n) + np.arange(len(h)) - np.repeat(bounds[:-1], n)] = place[f]
            for c in range(0, len(x), WINDOW << 13):
                part = x[c:c + (WINDOW << 13)]
                at = np.flatnonzero(part < len(known))
                if len(at):
                    y = np.concatenate([row_sums(random, part.reshape(-1, WINDOW)), random[-1:]])
                    k, s = summed_by(y, at // WINDOW, part[at])
                    sums[k] += s
    f = np.flatnonzero(total)
    yield _counted(np.append(f, -1), np.append(total[f], docs), np.append(words[f], 0))
    for c in range(0, len(known), 4096):
        yield _counted(known[c:c + 4096], None, None, sums[c:c + 4096])


def tfidf(h: np.ndarray, idf: np.ndarray):
    """``(features, weights)`` of a passage: counts times idf."""
    f, n = np.unique(feature(h), return_counts=True)
    return f, n * idf[f]


def normals(rows: np.ndarray, cols: int) -> np.ndarray:
    """Normal numbers, a fixed function of row and column."""
    h = mix(rows.astype(U)[:, None] * U(2 * cols) + np.arange(2 * cols, dtype=U) + U(0x2545F491))
    u = ((h >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.sqrt(-2 * np.log(u[:, :cols])) * np.cos(2 * np.pi * u[:, cols:])


def _item_sums(batches, idf, known):
    """Per task and feature: the sum over the items of its weight in the unit row times the item's sketch."""
    place, random = places(known), sketch(known)
    sums = np.zeros((len(known), RANK + EXTRA))
    for b in batches:
        for _, h in documents_words(b.column(0)):
            if len(h):
                f, w = tfidf(h, idf)
                w = w / max(np.linalg.norm(w), 1e-12)
                sums[place[f]] += w[:, None] * ((w / idf[f]) @ random[place[f]])
    f = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(known[f]), _counted(known[f], None, None, sums[f]).column(3)], names=["f", "row"])


def _summed(df: DataFrame, key: str, width: int):
    """Sums the lists of a key (one per task) element by element; the result has a fixed size and goes to the driver."""
    kind = df.schema["row"].dataType
    total = F.aggregate(F.collect_list("row"), F.array_repeat(F.lit(0.0), width).cast(kind), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    cells = df.groupBy(key).agg(total.alias("row")).toArrow()
    rows = cells.column(1).combine_chunks()
    return cells.column(0).to_numpy(), np.asarray(rows.flatten()).reshape(-1, width) if len(rows) else np.zeros((0, width))


def fit(texts: DataFrame, items: DataFrame):
    """``(idf, features, v)``: weights of all features, and the latent directions (rows x rank) of those that items have."""
    spark = texts.sparkSession
    known = np.sort(items.select("text").mapInArrow(_features, "f long").distinct().toArrow().column(0).to_numpy())  # 2**BITS at most
    sent = spark.sparkContext.broadcast(known)
    sums = written(texts.mapInArrow(functools.partial(_frequencies, sent=sent), "f long, n long, words long, row array<double>"), "frequencies")
    counts = sums.where("row IS NULL").groupBy("f").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()  # 2**BITS + 1 rows at most
    f, n, words = (c.to_numpy() for c in counts.columns)
    docs = max(int(n[f < 0].sum()), 1)
    df = np.zeros(1 << BITS)
    df[f[f >= 0]] = n[f >= 0]
    idf = np.log((docs + 1) / (df + 1)) + 0.05
    if not len(known):
        return idf, known, np.zeros((0, RANK), np.float32)
    width = RANK + EXTRA
    # the passages' whole weight, a word's being its idf squared
    mass = float((words[f >= 0] * idf[f[f >= 0]] ** 2).sum())
    c = np.zeros((len(known), width))
    place = places(known)
    for frame, scale in ((sums.where("row IS NOT NULL").select("f", "row"), idf[known] * (min(MASS, WEIGHT * docs) / max(mass, 1e-12))),
                         (items.select("text").mapInArrow(functools.partial(_item_sums, idf=idf, known=known), "f long, row array<double>"),
                          np.ones(len(known)))):
        at, rows = _summed(frame, "f", width)
        c[place[at]] += rows * scale[place[at]][:, None]
    gram = (sketch(known)[:-1] / idf[known][:, None]).T @ c
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    sound = values > max(values[-1], 0) * 1e-10
    if not sound.any():
        return idf, np.zeros(0, np.int64), np.zeros((0, RANK), np.float32)
    part = c @ (vectors[:, sound] / np.sqrt(values[sound]))
    values, vectors = np.linalg.eigh(part.T @ part)
    top = np.argsort(values)[::-1][:RANK]
    top = top[values[top] > values.max() * 1e-10]
    v = np.zeros((len(known), RANK), np.float32)
    v[:, :len(top)] = part @ (vectors[:, top] / np.sqrt(values[top]))
    return idf, known, v


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def contains(words: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(words) < len(part):
        return False
    for at in np.flatnonzero(words[:len(words) - len(part) + 1] == part[0]).tolist():
        if (words[at:at + len(part)] == part).all():
            return True
    return False


def verdict(words: np.ndarray, item: np.ndarray, answer: np.ndarray, begin: int, end: int, counted=None):
    """``(longest subsequence, answer found, leak)`` for an item against the words around ``[begin, end)``; stretches
    that can't be a leak are not aligned, and without any other the answer isn't looked for. ``counted``: the item's
    distinct words, sorted, and their counts."""
    n = len(item)
    lo, hi = max(0, begin - n), min(len(words), end + n)
    region = words[lo:hi]
    if n < SHORT:
        whole = contains(region, item)
        return n if whole else 0, whole, whole
    size, step, best = n + n // 4, max(1, n // 8), 0
    distinct, counts = counted or np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(distinct, region), len(distinct) - 1)
    known = np.flatnonzero(distinct[at] == region)
    if len(known) < LOOSE * n:
        return 0, False, False
    # a common subsequence can't be longer than the words the stretch shares with the item, counted: a word counts in the
    # stretches that hold it, but for those that hold as many of it before as the item has
    word = at[known]
    order = np.argsort(word, kind="stable")
    word, place = word[order], known[order]
    back = np.arange(len(word)) - counts[word]
    before = np.where((back >= 0) & (word[back] == word), place[back], -1)
    number = -(-max(1, len(region) - size + step) // step)
    first = np.minimum(np.maximum(before, place - size) // step + 1, number)
    last = np.minimum(place // step + 1, number)
    shared = np.cumsum(np.bincount(first, minlength=number + 1) - np.bincount(np.maximum(first, last), minlength=number + 1))
    if shared.max() < LOOSE * n:
        return 0, False, False
    said = contains(region, answer)
    least = LOOSE * n if said else SHARE * n
    for k in np.flatnonzero(shared >= least).tolist():
        if shared[k] > best:
            best = max(best, lcs(item, region[k * step:k * step + size]))
            if best == n:
                break
    return best, said, best >= SHARE * n or (said and best >= LOOSE * n)


def word_index(items: list, idf: np.ndarray) -> dict:
    """The rarest words of each item with the items that have them, and how many of them a leak holds at least within
    ``size`` words."""
    words, owners, least, sizes = [], [], [], []
    for k, item in enumerate(items):
        n = len(item)
        need = n if n < SHORT else math.ceil(LOOSE * n - 1e-9)
        w, count = np.unique(item, return_counts=True)
        weight = idf[feature(w)]
        order = np.lexsort((w, -weight))
        held = np.cumsum(count[order]) - (n - need)  # of the first words, with repeats, a leak has so many
        # the cheapest choice: expected look-ups and, a thousand times as dear, a bound on chance meetings (Chernoff)
        rate = np.cumsum(np.exp(-weight[order]))
        chance = np.exp(np.minimum(0, held - rate + held * np.log(np.maximum(rate, 1e-12) / np.maximum(held, 1))))
        cost = np.where(held < 1, np.inf, rate + 1000 * np.where(held > rate, chance, 1))
        p = int(np.argmin(cost))
        words.append(w[order[:p + 1]])
        owners.append(np.full(p + 1, k))
        least.append(int(held[p]))
        sizes.append(n + n // 4)
    words, owners = np.concatenate(words or [np.zeros(0, U)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(words, kind="stable")
    known, begin = np.unique(words[order], return_index=True)
    some = np.zeros(1 << BITS, bool)
    some[feature(known)] = True
    return {"some": some, "words": known, "begin": np.append(begin, len(words)), "owners": owners[order].astype(np.int16 if len(items) < 32768 else np.int64),
            "least": np.array(least, np.int64), "size": np.array(sizes, np.int64)}


def word_candidates(h: np.ndarray, bounds: np.ndarray, index: dict):
    """``(text, first word, end, item)`` of the stretches that hold enough of an item's rarest words; words between first
    and end, and an item's length around them, hold every stretch that can be a leak."""
    at = np.flatnonzero(index["some"][feature(h)])
    if len(at):
        v = np.searchsorted(index["words"], h[at])
        sure = index["words"][np.minimum(v, len(index["words"]) - 1)] == h[at]
        at, v = at[sure], v[sure]
    if not len(at):
        return [np.zeros(0, np.int64)] * 4
    gap = int(index["size"].max())
    text = np.searchsorted(bounds, at, side="right") - 1
    place = at + text * gap  # words of different texts are never within a size
    many = index["begin"][v + 1] - index["begin"][v]
    total = np.cumsum(many)
    out, a = [], 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(total, total[a] - many[a] + MEETINGS, side="right")))
        last = int(np.searchsorted(place, place[z - 1] + gap))  # stretches begun before z may end after it
        m = many[a:last]
        row = np.repeat(np.arange(a, last), m)
        item = index["owners"][np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index["begin"][v[a:last]], m)]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order].astype(np.int64)
        end = np.arange(len(row)) + index["least"][item] - 1
        ok = end < len(row)
        end = np.minimum(end, len(row) - 1)
        ok &= (row < z) & (item[end] == item) & (place[row[end]] - place[row] < index["size"][item])
        out.append((row[ok], row[end[ok]], item[ok]))
        a = z
    i, j, k = (np.concatenate(x) for x in zip(*out))
    size = index["size"][k]
    text, i, j = text[i], at[i] - bounds[text[i]], at[j] - bounds[text[i]]
    spare = size // 5 + 1
    return text, np.maximum(0, np.minimum(i, j + 1 - spare)), np.maximum(j + 1, i + spare), k


def nearness(words: np.ndarray, begin: int, end: int, k: int, model) -> float:
    """The best score of an item with the passages that begin in a stretch, or with the one that holds it."""
    best = 0.0
    for at in range(begin // STEP * STEP, max(begin + 1, end - STEP), STEP):
        f = feature(words[at:at + WINDOW])
        x = model["vectors"][model["of"] == k] @ model["v"][model["place"][f]].sum(0)
        best = max(best, float(x.max()) / max(float(np.linalg.norm(model["idf"][f])), 1e-9))
    return best


def candidates(h: np.ndarray, bounds: np.ndarray, model):
    """``(text, first word, item, score)`` of the passages of the texts that ``bounds`` cuts from the word hashes."""
    idf, v, place_of, items = model["idf"], model["v"], model["place"], model["vectors"]
    n = np.diff(bounds)
    blocks = -(-n // STEP)
    total = int(blocks.sum())
    if not total or not len(items):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    # words laid out in blocks of STEP, each text from a block of its own; gaps get the feature without weight
    place = np.repeat((np.cumsum(blocks) - blocks) * STEP, n) + np.arange(len(h)) - np.repeat(bounds[:-1], n)
    f = np.full(total * STEP, 1 << BITS, np.int64)
    f[place] = feature(h)
    w = idf[f]
    latent = row_sums(v, place_of[f].reshape(-1, STEP))  # rows of v hold idf times direction
    owner = np.repeat(np.arange(len(n)), blocks)
    pair = np.zeros(total, bool)
    pair[:-1] = owner[1:] == owner[:-1]
    only = blocks[owner] == 1
    at = np.flatnonzero(pair | only)
    nxt = np.where(pair[at], at + 1, at)
    rows = latent[at] + np.where((nxt != at)[:, None], latent[nxt], 0)
    squares = (w * w).reshape(total, STEP).sum(1)
    length = np.sqrt(squares[at] + np.where(nxt != at, squares[nxt], 0))
    out, least = [], float(model["cuts"].min()) * (1 - 1e-6)
    for c in range(0, len(at), 4096):
        s, long = rows[c:c + 4096] @ items.T, np.maximum(length[c:c + 4096], 1e-9)
        near = np.flatnonzero(s.max(1) >= long * least)  # only rows that can reach a cut are divided
        s = s[near] / long[near, None]
        i, k = np.nonzero(s >= model["cuts"])
        out.append((at[c + near[i]], model["of"][k], s[i, k]))
    i, k, s = (np.concatenate(x) for x in zip(*out))
    first = (i - (np.cumsum(blocks) - blocks)[owner[i]]) * STEP
    return owner[i], first, k, s


def scan(column, model):
    """Yields ``(row, item number, best score, longest subsequence, answer found, first word, leak)`` of the candidates."""
    data, off = buffers(column)
    for i, j in slices(off):
        h, t, _ = word_hashes(data, off[i:j + 1], MARKS)
        bounds = np.searchsorted(t, np.arange(j - i + 1))
        text, first, item, score = candidates(h, bounds, model)
        more = word_candidates(h, bounds, model["index"]) if model["index"] else [np.zeros(0, np.int64)] * 4
        text, first, item, end, score = (np.concatenate(x) for x in (
            (text, more[0]), (first, more[1]), (item, more[3]), (first + WINDOW, more[2]), (score, np.full(len(more[0]), -1.0))))
        order = np.lexsort((first, item, text))
        text, first, item, end, score = text[order], first[order], item[order], end[order], score[order]
        # neighbouring candidates of an item are one stretch
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (first[1:] - first[:-1] > WINDOW)
        cut = np.append(np.flatnonzero(fresh), len(text))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            words = h[bounds[text[a]]:bounds[text[a] + 1]]
            k = int(item[a])
            begin, stop, near = int(first[a]), int(end[a:z].max()), float(score[a:z].max())
            best, said, leak = verdict(words, model["items"][k], model["answers"][k], begin, stop, model["counted"][k])
            n = len(model["items"][k])
            if leak and best < SHARE * n:
                # many candidates can make a long stretch; the answer must stand around a passage of it
                leak = any(verdict(words, model["items"][k], model["answers"][k], at, at + WINDOW, model["counted"][k])[2]
                           for at in range(max(0, begin - n - WINDOW) // STEP * STEP, min(stop + n, max(1, len(words) - STEP)), STEP))
            if leak and near < 0:
                near = nearness(words, begin, stop, k, model)
            yield i + int(text[a]), k, near, best, said, begin, leak


def _leaks(batches, sent, id_col):
    model = sent.value
    for b in batches:
        best: dict = {}
        for row, k, score, n, said, first, leak in scan(b.column(1), model):
            if leak and (n, score) > best.get((row, k), ((-1, 0),))[0]:
                best[row, k] = ((n, score), said, first)
        keys = sorted(best)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([model["ids"][k] for _, k in keys], pa.int64()),
             pa.array([best[x][0][1] for x in keys], pa.float64()), pa.array([best[x][0][0] for x in keys], pa.int64()),
             pa.array([len(model["items"][k]) for _, k in keys], pa.int64()), pa.array([best[x][1] for x in keys], pa.bool_()),
             pa.array([best[x][2] for x in keys], pa.int64())],
            names=[id_col, "item_id", "cosine", "lcs", "item_words", "answer_found", "first_word"])


def _clean(batches, sent):
    model = sent.value
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        text = b.column(b.num_columns - 1)
        for row, *_, leak in scan(text, model):
            keep[row] &= not leak
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:-1]], names=b.schema.names[:-1])


def part_vectors(h: np.ndarray, idf: np.ndarray, v: np.ndarray, place: np.ndarray):
    """``(latent direction, cut)`` of each part of an item's words."""
    for part in np.array_split(h, -(-len(h) // PART)):
        f, w = tfidf(part, idf)
        x, n = w @ v[place[f]], len(part)
        own = float(np.linalg.norm(x) / max(np.linalg.norm(w), 1e-12))
        # a part outside the latent space has no direction to be found by
        cut = min(COSINE, FLOOR * own * math.sqrt(min(n, WINDOW) / max(n, WINDOW))) if own > 1e-6 else math.inf
        yield x / max(np.linalg.norm(x), 1e-12), cut


def models(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, answer_col: str | None,
           word_search: bool = True):
    """A broadcast model per block of items."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"),
                             (F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit("")).alias("answer"))
    idf, known, v = fit(texts, items)
    number = max(1, -(-items.count() // (BLOCK // 2)))
    # features that weren't fitted share a row of zeros at the end
    place = np.full((1 << BITS) + 1, len(known), np.int32)
    place[known] = np.arange(len(known))
    v = np.concatenate([v, np.zeros((1, RANK), np.float32)])
    weighted = v * np.append(idf[known], 0)[:, None].astype(np.float32)
    for block in range(number):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == block).orderBy("id", "text").toArrow().combine_chunks()
        ids, words, answers, vectors, cuts, of = [], [], [], [], [], []
        if part.num_rows:
            said = dict(documents_words(part.column("answer").combine_chunks()))
            for r, h in documents_words(part.column("text").combine_chunks()):
                if len(h):
                    for x, cut in part_vectors(h, idf, v, place):
                        vectors.append(x)
                        cuts.append(cut)
                        of.append(len(ids))
                    ids.append(part.column("id")[r].as_py())
                    words.append(h)
                    answers.append(said[r] if len(said[r]) else h[-min(ANSWER, max(1, len(h) // 3)):])
        model = {"idf": np.append(idf, 0.0), "v": weighted, "place": place, "ids": ids, "items": words, "answers": answers,
                 "counted": [np.unique(h, return_counts=True) for h in words],
                 "vectors": np.array(vectors, np.float32).reshape(-1, RANK), "cuts": np.array(cuts, np.float32),
                 "of": np.array(of, np.int64), "index": word_index(words, idf) if word_search else None}
        yield spark.sparkContext.broadcast(model)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", answer_col: str | None = None, word_search: bool = True) -> DataFrame:
    """A row per document and item that it leaks: id, ``item_id``, ``cosine``, ``lcs``, ``item_words``, ``answer_found``, ``first_word``."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id long, cosine double, lcs long, item_words long, "
              "answer_found boolean, first_word long")
    found = [rows.mapInArrow(functools.partial(_leaks, sent=m, id_col=id_col), schema)
             for m in models(docs, benchmark, text_col, item_col, item_text, answer_col, word_search)]
    return functools.reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    names = {"item_col": "item_id", "item_text": "text", "answer_col": None} | kw
    out = docs
    for m in models(docs, benchmark, text_col, **names):
        rows = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                          F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        row_type = rows.schema["row"].dataType.simpleString()
        out = rows.mapInArrow(functools.partial(_clean, sent=m), f"row {row_type}").select("row.*")
    return out
