"""Suffix-array dedup: removes bytes covered by strings of ``length`` bytes that occur more than once.

Texts are UTF-8 bytes and matches never cross texts. ``keep="none"`` removes every copy of a repeated string;
``keep="first"`` removes what occurs earlier too (in an earlier text, or further left), so the first copy stays.
Texts are ordered by their smallest id. Strings are judged on the input, not on what is left.

1. Equal texts are one text with a count; all but the first are later copies as a whole.
2. Every window of ``length`` bytes belongs to a cell: its ``GRAM``-byte string with the smallest hash. Equal
   windows lie in equal cells, so only cells with two fragments or more matter. A fragment is a stretch of
   neighbouring windows of a cell, ``length - GRAM + 1`` at most; fragments that are equal as a whole (64-bit digests
   of their bytes) need no comparison: each is a copy of the others. Tasks combine equal fragments before the
   shuffle, so a passage that a third of the texts share sends one row per task to its cell.
3. Different fragments of a cell meet in a suffix array: ranks of their windows by prefix doubling, the common
   prefixes of neighbours, and for every window the previous and next smaller position in suffix order. These
   two give its longest previous factor; where that reaches ``length``, the window occurs earlier. Mirrored,
   they give the later occurrences. Cells of over ``HOT`` different fragments (a frequent line in different
   surroundings) are dealt by the digests of their windows instead, so that no cell must fit into one task.
4. Marked windows are merged to spans per text, and texts are cut once, whatever the number of their copies.

Defined results: null text is empty; texts below ``length`` bytes lose nothing; repeated rows with one id count
as copies, and with ``keep="first"`` the rows that share the smallest id are all first copies; rows with a null
id come last; ids that aren't whole numbers are ordered by their hash; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import remove_tables, tables_so_far, written
from quarry.llm.shingles import _BYTE, U, buffers, mix, powers, slices

LENGTH, GRAM, HOT = 200, 100, 4096
#: Rows of a table of hot cells that are sent to every task; beyond, the tables are shuffled together.
MAX_SENT = 100_000
PIECE, COMBINED = 900_000, 1 << 20
LAST = (1 << 63) - 1


def prefix_sums(data: np.ndarray):
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * p[:len(data)], out=h[1:])
    return h


def digests(h, start, end):
    """64-bit digests of the byte strings ``[start, end)`` from prefix sums ``h``."""
    q = powers(len(h))[1]
    return mix((h[end] - h[start]) * q[start] + mix((end - start).astype(U)))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (w - have)], v[w - have:]) if have < w else v


def fragments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """``(text number, start in data, windows, several, cell, digest)`` of the fragments of the texts that ``bounds``
    cuts; ``several`` is 1 where the cell's string stands more than once in a fragment, which may then repeat itself."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    n = len(data) - length + 1
    if n < 1:
        return none
    h = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    g = digests(h, at, at + gram)
    low = U((1 << 20) - 1)
    first = sliding_min((g & ~low) | at.astype(U), length - gram + 1)  # of equal ones the leftmost
    place = (first & low).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(n), side="right") - 1
    ok = np.arange(n) + length <= bounds[text + 1]
    begin = ok.copy()
    cell = g[place]
    begin[1:] &= (cell[1:] != cell[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    s = np.flatnonzero(begin)
    if not len(s):
        return none
    # a run ends before the next one or where windows no longer fit into the text
    size = np.minimum(np.append(s[1:], n), bounds[text[s] + 1] - length + 1) - s
    # runs of one cell can be long in periodic text: they are cut into equal steps
    step = length - gram + 1
    count = -(-size // step)
    shift = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * step
    size = np.minimum(np.repeat(size, count) - shift, step)
    s = np.repeat(s, count) + shift
    several = (place[s] != place[s + size - 1]).astype(np.int64)
    return text[s], s, size, several, cell[s], digests(h, s, s + size - 1 + length)


def _entries(batches, length, gram):
    """Rows ``(route, kind, cell, frag, ord, txt, span)`` of the texts this task hasn't met with as small an id;
    ``span`` packs start, ``several`` and windows. Equal fragments of a task are combined before the shuffle: copies (kind 2)
    are decided here and go to any task by their text, the first one goes to its cell (kind 1: with copies, 0: without)."""
    seen: dict = {}
    held: list = []

    def new(t, o):
        if seen.get(t, LAST + 1) <= o:
            return False
        seen[t] = o
        return True

    def combined():
        cell, frag, order, txt, span = (np.concatenate(c) for c in zip(*held))
        held.clear()
        by = np.lexsort((span, txt, order, frag, cell))
        cell, frag, order, txt, span = cell[by], frag[by], order[by], txt[by], span[by]
        first, copy, has_copy = _copies(cell, frag, txt, span)
        rows = np.flatnonzero(first | copy)  # a text met again under a smaller id is no copy of itself
        kind = np.where(copy, 2, has_copy).astype(np.int32)[rows]
        route = np.where(copy, txt, cell)[rows]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (route, kind, cell[rows], frag[rows], order[rows], txt[rows], span[rows])],
                                          names=["route", "kind", "cell", "frag", "ord", "txt", "span"])

    for b in batches:
        data, off = buffers(b.column(2))
        txt, order = b.column(0).to_numpy(), b.column(1).to_numpy()
        fresh = np.array([new(t, o) for t, o in zip(txt.tolist(), order.tolist())], bool)
        for i, j in slices(off, PIECE):
            if j == i + 1 and off[j] - off[i] > PIECE:
                pieces = [(int(off[i]) + c, min(int(off[j]), int(off[i]) + c + PIECE + length - 1)) for c in range(0, int(off[j] - off[i]), PIECE)]
            else:
                pieces = [(int(off[i]), int(off[j]))]
            for x, y in pieces:
                bounds = np.clip(off[i:j + 1], x, y) - x
                t, s, size, several, cell, frag = fragments(data[x:y], bounds, length, gram)
                t = t + i
                use = fresh[t]
                t, s = t[use], s[use]
                start = s + x - off[t]
                held.append((cell[use].view(np.int64), frag[use].view(np.int64), order[t], txt[t],
                             (start << 8) | (several[use] << 7) | size[use]))
                if sum(len(h[0]) for h in held) >= COMBINED:
                    yield combined()
    if held:
        yield combined()


def _copies(cell, frag, txt, span):
    """For sorted rows: the first of each fragment, later ones of other places, and firsts that have such a copy."""
    first = np.ones(len(cell), bool)
    first[1:] = (cell[1:] != cell[:-1]) | (frag[1:] != frag[:-1])
    head = np.flatnonzero(first)
    lead = np.repeat(head, np.diff(np.append(head, len(cell))))
    copy = ~first & ((txt != txt[lead]) | (span != span[lead]))
    has_copy = np.zeros(len(cell), bool)
    has_copy[lead[copy]] = True
    return first, copy, has_copy


def _runs(batches):
    """The sorted rows of each batch up to its last complete cell, as NumPy columns."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(b.num_columns)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        last = int(np.flatnonzero(cols[0] == cols[0][-1])[0])
        if last:
            yield [c[:last] for c in cols]
        rest = [c[last:] for c in cols]
    if rest is not None:
        yield rest


def _cells(batches):
    """From rows sorted by (route, cell, frag, ord, txt, span): ``(kind, cell, ord, txt, span)``; kind 2: a later copy of an
    equal fragment, 1: the first of equal fragments, 0: a fragment to compare with others of its cell and with itself."""
    for route, known, cell, frag, order, txt, span in _runs(batches):
        done = known == 2
        later = [np.flatnonzero(done)]
        rest = np.flatnonzero(~done)
        known, cell2, frag, txt2, span2 = known[rest], cell[rest], frag[rest], txt[rest], span[rest]
        # a text that several tasks have met comes once per task: same fragment, text and span
        first, copy, has_copy = _copies(cell2, frag, txt2, span2)
        head = np.flatnonzero(first)
        lead = np.repeat(head, np.diff(np.append(head, len(rest))))
        has_copy[lead[known == 1]] = True
        begin = np.ones(len(rest), bool)
        begin[1:] = cell2[1:] != cell2[:-1]
        group = np.cumsum(begin) - 1
        several = np.bincount(group, weights=first) > 1 if len(rest) else np.zeros(0, bool)
        later.append(rest[copy])
        ones = rest[first & has_copy]
        compare = rest[first & (several[group] | ((span2 & 128) != 0))]
        rows = np.concatenate([*later, ones, compare])
        kind = np.repeat(np.array([2, 2, 1, 0], np.int32), [*map(len, later), len(ones), len(compare)])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(cell[rows]), pa.array(order[rows]), pa.array(txt[rows]), pa.array(span[rows])],
                                             names=["kind", "cell", "ord", "txt", "span"])


def window_ranks(data: np.ndarray, at: np.ndarray, length: int):
    """Two numbers per window start in ``at`` that order the windows by their ``length`` bytes: ranks of 8, 16, ...
    bytes by prefix doubling, then those of the longest power of two below ``length`` at both ends."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    word = np.zeros(len(data), U)
    for j in range(8):
        word |= pad[j:j + len(data)] << U(56 - 8 * j)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have * 2 <= length:
        key = rank * np.int64(len(data))
        key[:len(key) - have] += rank[have:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        have *= 2
    return rank[at], rank[at + length - have]


def earlier_and_later(group, data, at, length):
    """For windows in the order of their places: whether an equal window of the group is earlier, and later. In
    suffix order with ties by place, the previous smaller position that shares ``length`` bytes is the left
    neighbour if its common prefix reaches ``length``, and the next one the right neighbour."""
    one, two = window_ranks(data, at, length)
    order = np.lexsort((two, one, group))  # stable: ties keep the order of places
    same = (group[order][1:] == group[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _fragments_of(batches, length):
    """From rows ``(txt, text, marks)``: ``(cell, ord, txt, start, windows, bytes)`` of the fragments to compare; those of hot
    cells (kind 3) window by window, with a cell named by the window's digest and no bytes."""
    seen = set()
    for b in batches:
        cell, order, txt, start, size, data = [], [], [], [], [], []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array(order, pa.int64()), pa.array(txt, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["cell", "ord", "txt", "start", "windows", "bytes"])
        held = 0
        for r in range(b.num_rows):
            t = b.column(0)[r].as_py()
            if t in seen:
                continue
            seen.add(t)
            raw = b.column(1)[r].as_py().encode()
            for kind, c, o, span in zip(*(b.column(i)[r].as_py() for i in range(2, 6))):
                s, n = span >> 8, span & 127
                if kind == 0:
                    cell.append(c)
                    order.append(o)
                    txt.append(t)
                    start.append(s)
                    size.append(n)
                    data.append(raw[s:s + n - 1 + length])
                    held += n - 1 + length
                elif kind == 3:
                    part = np.frombuffer(raw[s:s + n - 1 + length], np.uint8)
                    x = np.arange(n)
                    names = mix(digests(prefix_sums(part), x, x + length) ^ np.full(1, c & 0xFFFFFFFFFFFFFFFF, U)).view(np.int64)
                    cell += names.tolist()
                    order += [o] * n
                    txt += [t] * n
                    start += range(s, s + n)
                    size += [1] * n
                    data += [None] * n
                    held += 40 * n
                if held > 4_000_000:
                    yield out()
                    cell, order, txt, start, size, data, held = [], [], [], [], [], [], 0
        if cell:
            yield out()


def _compared(batches, length, keep):
    """From fragments sorted by (cell, ord, txt, start): marked windows ``(txt, start, windows)``."""
    for part in _complete(batches):
        cell, order, txt, start, size = (part.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (txt[1:] != txt[:-1]) | (start[1:] != start[:-1])
        bare = np.asarray(part.column(5).is_null())
        rows = np.flatnonzero(fresh & bare)
        if len(rows):  # single windows: equal names are equal windows
            same = cell[rows][1:] == cell[rows][:-1]
            hit = np.zeros(len(rows), bool)
            hit[1:] = same
            if keep == "none":
                hit[:-1] |= same
            yield _marks(txt[rows[hit]], start[rows[hit]], np.ones(int(hit.sum()), np.int64))
        rows = np.flatnonzero(fresh & ~bare)
        if not len(rows):
            continue
        data = np.frombuffer(b"".join(part.column(5).take(pa.array(rows)).to_pylist()), np.uint8)
        cell, txt, start, size = cell[rows], txt[rows], start[rows], size[rows].astype(np.int64)
        base = np.concatenate([[0], np.cumsum(size - 1 + length)])[:-1]
        shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        owner = np.repeat(np.arange(len(size)), size)
        earlier, later = earlier_and_later(np.repeat(cell, size), data, base[owner] + shift, length)
        hit = earlier | later if keep == "none" else earlier
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        cut = np.append(np.flatnonzero(edge), len(hit))
        run, n = cut[:-1][hit[cut[:-1]]], np.diff(cut)[hit[cut[:-1]]]
        yield _marks(txt[owner[run]], start[owner[run]] + shift[run], n)


def _marks(txt, start, windows):
    return pa.RecordBatch.from_arrays([pa.array(txt), pa.array(start), pa.array(windows)], names=["txt", "start", "windows"])


def _complete(batches, most: int = 1 << 19):
    """Record batches of whole cells of about ``most`` bytes from rows sorted by cell."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks().to_batches()[0]
        cell = t.column(0).to_numpy()
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        ends = np.cumsum(np.asarray(t.column(5).is_null()) * 40 + np.where(np.asarray(t.column(5).is_valid()), t.column(4).to_numpy() + LENGTH, 0))
        at = 0
        while True:
            more = cuts[cuts > at]
            if not len(more):
                break
            far = more[ends[more - 1] <= (ends[at - 1] if at else 0) + most]
            stop = int(far[-1] if len(far) else more[0])
            yield t.slice(at, stop - at)
            at = stop
        rest = t.slice(at)
    if rest is not None:
        yield rest


def merge(marks, length: int):
    """Maximal byte spans ``(start, end)`` covered by marked windows ``(start, windows)``."""
    spans: list = []
    for s, n in sorted(marks):
        e = s + n - 1 + length
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return spans


def _cut(batches, length, keep):
    """From rows ``(row, ord, text, copies, first, kind list, span list, start list, windows list)``: ``(row, n_bytes,
    n_removed, n_spans, kept_sha256, kept_text)``."""
    marked = (1, 2) if keep == "none" else (2,)
    for b in batches:
        n_bytes, removed, spans_out, sha, kept = [], [], [], [], []
        cols = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
        for order, text, copies, first, kinds, spans, starts, sizes in zip(*cols):
            raw = text.encode()
            if copies is not None and len(raw) >= length and (keep == "none" or order != first):
                parts = [[0, len(raw)]]
            else:
                marks = [(s >> 8, s & 127) for k, s in zip(kinds or (), spans or ()) if k in marked]
                parts = merge(marks + list(zip(starts or (), sizes or ())), length)
            left, at = [], 0
            for s, e in parts:
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            left = b"".join(left)
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(left))
            spans_out.append(len(parts))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, pa.int64()),
                                          pa.array(sha), pa.array(kept)], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", length: int = LENGTH,
                 gram: int = GRAM, columns: list | None = None, with_text: bool = True) -> DataFrame:
    """One row per input row: its ``columns`` (default: all) in a struct ``row``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` of the remaining bytes, and (``with_text``) ``kept_text``, without characters that a cut has split."""
    if not length - gram < 127 or keep not in ("none", "first"):
        raise ValueError("length - gram must be below 127 and keep 'none' or 'first'")
    since = tables_so_far()
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    order = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(id_col), F.lit(LAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), order.alias("ord"), text.alias("text"))
    rows = rows.withColumn("txt", F.xxhash64("text"))
    entries = rows.select("txt", "ord", "text").mapInArrow(functools.partial(_entries, length=length, gram=gram),
                                                           "route long, kind int, cell long, frag long, ord long, txt long, span long")
    cells = written(entries.repartition("route").sortWithinPartitions("route", "cell", "frag", "ord", "txt", "span")
                    .mapInArrow(_cells, "kind int, cell long, ord long, txt long, span long"), "cells")
    hot = written(cells.where("kind = 0").groupBy("cell").count().where(F.col("count") > HOT).select("cell", F.lit(3).alias("_hot")), "hot")
    # at most a row per HOT entries: sent while few, so that a hot cell's rows stay where they lie; AQE splits them beyond
    marks = (cells.join(F.broadcast(hot) if hot.count() <= MAX_SENT else hot, "cell", "left").withColumn("kind", F.when(F.col("kind") == 0, F.coalesce("_hot", "kind")).otherwise(F.col("kind")))
             .groupBy("txt").agg(F.collect_list(F.struct("kind", "cell", "ord", "span")).alias("m")))
    copies = rows.groupBy("txt").agg(F.count("*").alias("copies"), F.min("ord").alias("first")).where("copies > 1")
    marks = marks.join(copies, "txt", "full").withColumnRenamed("txt", "_t")
    # a text with copies is judged where its smallest id is: elsewhere it was placed too late
    marks = marks.withColumn("m", F.expr("filter(m, x -> copies IS NULL OR x.ord = first)"))
    known = rows.join(marks, F.col("txt") == F.col("_t"), "left")
    touched = F.col("_t").isNotNull()
    known = written(known.select(
        "row", "ord", "txt", "copies", "first", F.col("m.kind").alias("kinds"), F.col("m.cell").alias("cells"), F.col("m.ord").alias("ords"),
        F.col("m.span").alias("spans"), (F.col("text") if with_text else F.when(touched, F.col("text"))).alias("text"),
        touched.alias("touched"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(~touched, F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "known")
    remove_tables(docs.sparkSession, since, [known])
    compare = known.where("exists(kinds, k -> k = 0 or k = 3)").select("txt", "text", "kinds", "cells", "ords", "spans")
    found = (compare.mapInArrow(functools.partial(_fragments_of, length=length),
                                "cell long, ord long, txt long, start long, windows int, bytes binary")
             .repartition("cell").sortWithinPartitions("cell", "ord", "txt", "start")
             .mapInArrow(functools.partial(_compared, length=length, keep=keep), "txt long, start long, windows long"))
    found = found.groupBy(F.col("txt").alias("_t")).agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("sizes"))
    row_type = known.schema["row"].dataType.simpleString()
    cut = (known.where("touched").join(found, F.col("txt") == F.col("_t"), "left")
           .select("row", "ord", "text", "copies", "first", "kinds", "spans", "starts", "sizes")
           .mapInArrow(functools.partial(_cut, length=length, keep=keep),
                       f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"))
    rest = known.where("not touched").select("row", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                                             F.col("sha").alias("kept_sha256"), F.col("text").alias("kept_text"))
    out = cut.union(rest)
    return out if with_text else out.drop("kept_text")
