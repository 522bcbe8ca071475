"""N-gram Jaccard join with a count-vector R-tree.

A document's set are the distinct ``k``-word shingles of its whole text (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; fewer than ``k`` words: the whole sequence as one). Two sets link when
``den * |x & y| >= num * |x | y|``. Result: a row per document with the size of its set and its component.

1. Every distinct set is one node, named by a 64-bit digest of its shingles, so exact copies are one node
   whatever their number.
2. Shingles are ordered by the number of documents that share their hash group (2**18 groups counted over all
   texts, rare groups first). Sets that link share a shingle among their first ``n - ceil(num * n / den) + 1``
   ones; each of those shingles is a cell, and a set lies in the cells of its prefix. Shingles that many
   documents share stand last and seldom open a cell.
3. Every node is a point: its shingles hashed into ``DIMS`` groups and counted. The sum of the smaller
   coordinates of two points bounds the overlap of their sets, and the coordinate-wise maxima of boxes bound
   it for all points below them. A cell of up to ``LEAF`` points is one leaf, whose pairs are bounded one by
   one; a larger cell is an R-tree that is descended in pairs of boxes. In each cell the nodes are met with a hub
   first; where that has joined some but not all, up to ``HUB_ROUNDS`` times ``HUBS`` more hubs meet the members outside
   of their component, and only pairs that are in different components afterwards are looked for in the tree. Cells above
   ``TILE`` points are cut into tiles, a task for each pair of tiles.
4. Pairs that survive are verified on the whole sets. What is skipped are pairs whose ends are linked already.

Not all pairs of a group of near copies are emitted: a cell of any size adds a star of pairs, then ``HUBS`` a round, each
to the members that earlier rounds have left apart, and then only pairs between components.

Defined results: null or blank text has an empty set, is linked with nothing and is its own component;
repeated rows are separate rows; the component is the smallest non-null id of its documents (null if all are
null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import remove_tables, tables_so_far, written
from quarry.llm.components import components
from quarry.llm.shingles import U, mix, shingle_sets

GROUP_BITS, DIM_BITS = 18, 8
DIMS = 1 << DIM_BITS
LEAF, TILE = 16, 4096
HUB_ROUNDS, HUBS = 3, 3
FILTER_BITS, KEPT = 26, 32 << 20
SUMMARY = ["id", "key", "n", "node", "point", "grp", "cnt"]


def need(nx, ny, num: int, den: int):
    """Smallest overlap of linked sets of these sizes."""
    return -(-num * (nx + ny) // (num + den))


def digest(s: np.ndarray) -> int:
    """Name of a set of sorted distinct shingle hashes, as a signed 64-bit number."""
    return int(mix(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U, keepdims=True) + np.full(1, len(s), U)).view(np.int64)[0])


def _summaries(batches, k):
    """Rows ``(id, key, n, node, point, grp, cnt)``: a row per text, and per task the texts of each hash group."""
    totals = np.zeros(1 << GROUP_BITS, np.int64)
    for b in batches:
        n, node, point, held = [], [], [], []
        for _, s in shingle_sets(b.column(2), k):
            n.append(len(s))
            node.append(digest(s) if len(s) else None)
            counts = np.bincount((s >> U(64 - DIM_BITS)).astype(np.int64), minlength=DIMS)
            point.append(counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes())
            held.append(s)
            if len(held) >= 256:
                totals += np.bincount((np.concatenate(held) >> U(64 - GROUP_BITS)).astype(np.int64), minlength=len(totals))
                held.clear()
        if held:
            totals += np.bincount((np.concatenate(held) >> U(64 - GROUP_BITS)).astype(np.int64), minlength=len(totals))
        m = len(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(point, pa.binary()),
                                          pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=SUMMARY)
    g = np.flatnonzero(totals)
    if len(g):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(g), b.column(0).type), *[pa.nulls(len(g), pa.int64())] * 3,
                                          pa.nulls(len(g), pa.binary()), pa.array(g.astype(np.int32)), pa.array(totals[g])], names=SUMMARY)


def _entries(batches, k, num, den, ranks):
    """Rows ``(cell, node, np)``: the prefix of every set this task hasn't met, size and position packed in ``np``."""
    rank, seen = ranks.value, set()
    low = U((1 << (64 - GROUP_BITS)) - 1)
    for b in batches:
        cell, node, npos = [], [], []

        def out():
            sizes = [len(c) for c in cell]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).view(np.int64)), pa.array(np.repeat(np.array(node, np.int64), sizes)),
                                               pa.array(np.concatenate(npos))], names=["cell", "node", "np"])
        held = 0
        for _, s in shingle_sets(b.column(0), k):
            if not len(s):
                continue
            d = digest(s)
            if d in seen:
                continue
            seen.add(d)
            key = (rank[(s >> U(64 - GROUP_BITS)).astype(np.int64)] << U(64 - GROUP_BITS)) | (s & low)
            p = len(s) - -(-num * len(s) // den) + 1
            key = np.sort(np.partition(key, p - 1)[:p] if p < len(key) else key)
            cell.append(key)
            node.append(d)
            npos.append((np.int64(len(s)) << 32) | np.arange(p, dtype=np.int64))
            held += p
            if held > 200_000:
                yield out()
                cell, node, npos, held = [], [], [], 0
        if cell:
            yield out()


def possible(nx, px, ny, py, num, den):
    """Length filter, and position filter for sets that meet first at these places."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (den * small >= num * large) & (np.minimum(px, py) + np.minimum(nx - px, ny - py) >= need(nx, ny, num, den))


def _runs(batches):
    """The sorted rows of each batch up to its last complete cell, as NumPy columns."""
    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if last:
            yield [c[:last] for c in cols]
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def parted(cell, node, npos, num, den):
    """Cells cut, from rows sorted by cell, where the sets that stand next to each other in size, or in the place of the
    shingle, can't link: sets on either side of a cut can't link either. Parts of one set go."""
    group = np.cumsum(np.concatenate([[False], cell[1:] != cell[:-1]]))
    some = np.bincount(group)[group] > 1
    cell, node, npos, group = cell[some], node[some], npos[some], group[some]
    for what in ("n", "p", "n"):
        if not len(cell):
            return cell, node, npos
        n, p = npos >> 32, npos & 0xFFFFFFFF
        order = np.lexsort((n if what == "n" else p, group))
        cell, node, npos, group, n, p = (x[order] for x in (cell, node, npos, group, n, p))
        new = group[1:] != group[:-1]
        if what == "n":
            cut = den * n[:-1] < num * n[1:]
        else:
            # a pair overlaps in at most the size of the set with the later place less the distance of the places
            begin = np.flatnonzero(np.concatenate([[True], new]))
            many = np.diff(np.append(begin, len(group)))
            low, high = (np.repeat(f.reduceat(n, begin), many)[1:] for f in (np.minimum, np.maximum))
            cut = (num + den) * (p[1:] - p[:-1]) > den * high - num * low
        group = np.cumsum(np.concatenate([[False], new | cut]))
        some = np.bincount(group)[group] > 1
        cell, node, npos, group = cell[some], node[some], npos[some], group[some]
    if not len(cell):
        return cell, node, npos
    # the parts are named by the cell and their smallest set
    order = np.lexsort((node, group))
    cell, node, npos, group = (x[order] for x in (cell, node, npos, group))
    first = np.concatenate([[True], group[1:] != group[:-1]])
    least = node[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))]
    return mix(cell.view(U) ^ mix(least.view(U))).view(np.int64), node, npos


def _cells(batches, num, den):
    """From rows sorted by (cell, node): pairs of each cell's hub with its members ``(null, a, b)``, and the members of
    cells of three or more ``(cell, node, null)``. The hub is the node with the smallest hash, so that cells of
    the same documents have the same hub."""
    for cell, node, npos in _runs(batches):
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])  # copies met by several tasks
        cell, node, npos = parted(cell[fresh], node[fresh], npos[fresh], num, den)
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(begin, len(cell)))
        shared = np.repeat(size > 1, size)
        cell, node, npos, each = cell[shared], node[shared], npos[shared], np.repeat(size, size)[shared]
        if not len(cell):
            continue
        order = np.lexsort((mix(node.view(U)), cell))
        cell, node, npos, each = cell[order], node[order], npos[order], each[order]
        n, p = npos >> 32, npos & 0xFFFFFFFF
        first = np.concatenate([[True], cell[1:] != cell[:-1]])
        hub = np.maximum.accumulate(np.where(first, np.arange(len(cell)), 0))
        ok = ~first & possible(n, p, n[hub], p[hub], num, den)
        pairs = np.unique(np.stack([np.minimum(node[ok], node[hub[ok]]), np.maximum(node[ok], node[hub[ok]])], 1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["cell", "a", "b"])
        more = each > 2
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(cell[more]), pa.array(node[more]), pa.nulls(int(more.sum()), pa.int64())], names=["cell", "a", "b"])


def points(column) -> np.ndarray:
    """Points from bytes: one byte per coordinate, or four where a count needs them."""
    rows = column.to_pylist()
    if all(len(r) == DIMS for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, DIMS)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == DIMS else np.int32).astype(np.int32) for r in rows])


def _bounded(batches, num, den):
    """Keeps pairs ``(a, b, n_a, point_a, n_b, point_b)`` whose summed minima reach the overlap they need."""
    for b in batches:
        if b.num_rows:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            ok = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (
                np.minimum(points(b.column(3)), points(b.column(5))).sum(1, dtype=np.int64) >= need(na, nb, num, den))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])


class RTree:
    """Points sorted by size and packed ``LEAF`` to a box, boxes ``LEAF`` to a box above; a box keeps the largest
    value of every coordinate and the range of sizes."""

    def __init__(self, p: np.ndarray, n: np.ndarray):
        order = np.lexsort((p[:, 0], n))
        self.rows, levels = order, [(p[order], n[order], n[order])]
        while len(levels[-1][0]) > 1:
            q, lo, hi = levels[-1]
            at = np.arange(0, len(q), LEAF)
            levels.append((np.maximum.reduceat(q, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
        self.levels = levels

    def meets(self, depth, i, j, num, den):
        q, lo, hi = self.levels[depth]
        # the sizes nearest to each other that boxes i and j allow, and the least overlap any pair needs
        near = den * np.minimum(hi[i], hi[j]) >= num * np.maximum(lo[i], lo[j])
        ok = np.flatnonzero(near)
        if not len(ok):
            return ok
        keep = []
        for c in range(0, len(ok), 16384):
            x = ok[c:c + 16384]
            keep.append(x[np.minimum(q[i[x]], q[j[x]]).sum(1, dtype=np.int64) >= need(lo[i[x]], lo[j[x]], num, den)])
        return np.concatenate(keep)


def tree_pairs(tree: RTree, num: int, den: int, wanted, out_rows: int = 1 << 18):
    """Yields pairs of rows whose bound reaches what they need, descending the tree in pairs of boxes.
    ``wanted(rows, rows)`` marks pairs that are of use at the leaves."""
    stack = [(len(tree.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        depth, i, j = stack.pop()
        ok = tree.meets(depth, i, j, num, den)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if depth == 0:
            use = wanted(tree.rows[i], tree.rows[j])
            if use.any():
                yield tree.rows[i[use]], tree.rows[j[use]]
            continue
        below = len(tree.levels[depth - 1][0])
        step = max(1, out_rows // (LEAF * LEAF))
        for c in range(0, len(i), step):
            x, y = i[c:c + step], j[c:c + step]
            a = (x[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).ravel()
            b = (y[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).ravel()
            ok = (a < below) & (b < below) & ((a < b) if depth == 1 else (a <= b))
            stack.append((depth - 1, a[ok], b[ok]))


def _descend(batches, num, den):
    """Rows ``(tile, node, component, n, side, point, cell, cells)`` sorted by tile: pairs of different components and, in
    a tile of two sides, of different sides, that pass the bounds. A pair that shares several cells is emitted in
    the smallest of them, so that a group's many common cells don't multiply its pairs."""
    import pyarrow.compute as pc
    rest = None
    for b in _chain(batches):
        if b is not None:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if not rest.num_rows:
                continue
            last = rest.column(0)[-1]
            done = rest.filter(pc.not_equal(rest.column(0), last))
            keep = rest.filter(pc.equal(rest.column(0), last))
        else:
            done, keep = rest, None
        if done is not None and done.num_rows:
            done = done.combine_chunks()
            tile = np.array(done.column(0).to_pylist(), object)
            cut = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
            for x, y in zip(cut[:-1], cut[1:]):
                part = done.slice(x, y - x)
                node, comp, n, side = (part.column(c).to_numpy() for c in range(1, 5))
                if (comp == comp[0]).all():
                    continue
                tree = RTree(points(part.column(5).combine_chunks()), n)
                two = len(np.unique(side)) > 1
                here, sets = part.column(6)[0].as_py(), [set(x) for x in part.column(7).to_pylist()]

                def wanted(i, j):
                    return (comp[i] != comp[j]) & ((side[i] != side[j]) if two else True)
                for i, j in tree_pairs(tree, num, den, wanted):
                    mine = np.array([min(sets[x] & sets[y]) == here for x, y in zip(i.tolist(), j.tolist())], bool)
                    i, j = i[mine], j[mine]
                    p, q = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])
        rest = keep


def _chain(batches):
    yield from batches
    yield None


def _wanted_texts(batches, bitmap):
    """Rows ``(key, text)`` of the texts whose bit is set, each once per task, texts compressed (less than half of
    their shingles' hashes); the filter may let others through."""
    import zstandard
    bits, seen, press = bitmap.value, set(), zstandard.ZstdCompressor(level=3)
    for b in batches:
        key = b.column(0).to_numpy()
        slot = key & ((1 << FILTER_BITS) - 1)
        rows = [r for r in np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(U)) & U(1)).tolist()
                if not (int(key[r]) in seen or seen.add(int(key[r])))]
        if rows:
            texts = [press.compress(x.encode()) for x in b.column(1).take(pa.array(rows)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(texts, pa.binary())], names=["key", "z"])


def _verified(batches, k, num, den):
    """From ``(a, b, text of a, text of b)``: the pairs whose sets link. Sets that were made are kept up to ``KEPT``
    bytes, as nodes come again."""
    import zstandard
    unpress, made, held = zstandard.ZstdDecompressor(), {}, 0

    def of(node, z):
        nonlocal held
        if node not in made:
            if held > KEPT:
                made.clear()
                held = 0
            made[node] = dict(shingle_sets(pa.array([unpress.decompress(z).decode()], pa.large_string()), k))[0]
            held += made[node].nbytes
        return made[node]
    for b in batches:
        keep = []
        for i, j, x, y in zip(*(c.to_pylist() for c in b.columns)):
            x, y = of(i, x), of(j, y)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(den * both >= num * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def verify(texts: DataFrame, keys: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose whole sets link, from ``texts (key, text)`` and ``keys (node, key)``. Texts of
    nodes outside of pairs are left out by a bitmap of fixed size (2**26 bits), which lets some through but none out."""
    spark = texts.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(keys, "node")
    nodes = written(nodes, "wanted")
    slot = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (nodes.groupBy(F.shiftright(slot, 6).alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toArrow())  # at most 2**20 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    bitmap = spark.sparkContext.broadcast(bits.view(U))
    some = texts.mapInArrow(functools.partial(_wanted_texts, bitmap=bitmap), "key long, z binary")
    some = written(some.join(nodes, "key").groupBy("node").agg(F.first("z").alias("z")), "texts")  # tasks may both have a copy
    bitmap.destroy()
    both = (pairs.join(some.select(F.col("node").alias("a"), F.col("z").alias("x")), "a")
            .join(some.select(F.col("node").alias("b"), F.col("z").alias("y")), "b").select("a", "b", "x", "y"))
    return written(both.mapInArrow(functools.partial(_verified, k=k, num=num, den=den), "a long, b long"), "links")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component, moved)`` of every node after ``links``, from ``joined (node, component)``; ``moved`` where the
    links changed the component. Only the components that links join are contracted again."""
    ends = links.join(joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
    ends = ends.join(joined.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select("ca", "cb")
    up = components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = joined.select("node", "component").join(up, "component", "left")
    now = F.coalesce("_to", "component")
    return written(out.select("node", now.alias("component"), (now != F.col("component")).alias("moved")), "joined")


def _open_cells(cells: DataFrame, joined: DataFrame, moved: bool) -> DataFrame:
    """``(cell, node, component, size)`` of the cells whose members are in different components, one of those with the same
    members; with ``moved`` only cells of which a member has changed its component in the last round."""
    members = cells.select("cell", "node").join(joined, "node")
    found = members.groupBy("cell").agg(F.count("*").alias("size"), F.sum(F.col("node").cast("decimal(38,0)")).alias("sum"),
                                        (F.min("component") != F.max("component")).alias("open"), F.max("moved").alias("any"))
    found = found.where(F.col("open") & F.col("any") if moved else F.col("open")).groupBy("size", "sum").agg(F.min("cell").alias("cell"))
    return members.select("cell", "node", "component").join(found.select("cell", "size"), "cell")


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int):
    """``(facts, components)``: a row ``(id, key, n, node)`` per document (``key``: digest of the text), and
    ``(node, component)`` of every node."""
    spark, since = docs.sparkSession, tables_so_far()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = written(rows.mapInArrow(functools.partial(_summaries, k=k),
                                    f"id {id_type}, key long, n long, node long, point binary, grp int, cnt long"), "summaries")
    counts = facts.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.sum("cnt").alias("cnt")).toArrow()  # 2**18 rows at most
    total = np.zeros(1 << GROUP_BITS, np.int64)
    total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    rank = np.empty(len(total), U)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=U)
    ranks = spark.sparkContext.broadcast(rank)
    facts = facts.where(F.col("grp").isNull())
    nodes = facts.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"),
                                                                       F.min("key").alias("key"))
    nodes = written(nodes, "nodes")
    texts, keys = rows.select("key", "text"), nodes.select("node", "key")

    entries = rows.select("text").mapInArrow(functools.partial(_entries, k=k, num=num, den=den, ranks=ranks), "cell long, node long, np long")
    cells = (entries.repartition("cell").sortWithinPartitions("cell", "node")
             .mapInArrow(functools.partial(_cells, num=num, den=den), "cell long, a long, b long"))
    cells = written(cells, "cells")
    ranks.destroy()

    def at(side):
        return nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("point").alias(f"point_{side}"))

    def linked(pairs):
        """The pairs that pass the bound, and those of them whose sets link."""
        pairs = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "n_a", "point_a", "n_b", "point_b")
        pairs = written(pairs.mapInArrow(functools.partial(_bounded, num=num, den=den), "a long, b long"), "pairs")
        return pairs, verify(texts, keys, pairs, k, num, den)
    tried, links = linked(cells.where(F.col("cell").isNull()).select("a", "b").distinct())
    joined = _merged(nodes.select("node", F.col("node").alias("component")), links)
    cells = cells.where(F.col("cell").isNotNull()).select("cell", F.col("a").alias("node"))

    # more hubs for cells that the last ones have joined in part
    for turn in range(HUB_ROUNDS):
        members = written(_open_cells(cells, joined, moved=True), "members")
        if members.isEmpty():
            break
        first = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + j)).alias("h"), "node", "component")) for j in range(HUBS)]
        hubs = members.groupBy("cell").agg(F.array(*first).alias("hubs")).select("cell", F.explode("hubs").alias("hub"))
        new = members.join(hubs, "cell").where("component <> hub.component").select(
            F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        pairs, links = linked(new.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        if links.isEmpty():  # nothing has moved
            break
        joined = _merged(joined, links)

    # what is left in different components is looked for in the tree
    inside = _open_cells(cells, joined, moved=False).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    inside = written(inside, "members")
    lists = inside.groupBy("node").agg(F.collect_list("cell").alias("cells"))  # at most a node's prefix
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiles = (inside.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("tile", F.concat_ws("/", "cell", F.least("own", "other"), F.greatest("own", "other")))
             .join(nodes.select("node", "n", "point"), "node").join(lists, "node")
             .select("tile", "node", "component", "n", F.col("own").alias("side"), "point", "cell", "cells"))
    more = (tiles.repartition("tile").sortWithinPartitions("tile")
            .mapInArrow(functools.partial(_descend, num=num, den=den), "a long, b long").join(tried, ["a", "b"], "left_anti"))
    more = written(more, "more")
    if not more.isEmpty():
        joined = _merged(joined, verify(texts, keys, more, k, num, den))

    named, facts = written(joined.select("node", "component"), "named"), written(facts.select("id", "key", "n", "node"), "facts")
    remove_tables(spark, since, [named, facts])
    return facts, named


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``."""
    facts, named = _grouped(docs, id_col, text_col, k, num, den)
    low = facts.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("low"))
    named = named.join(low, "node")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    out = facts.join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of ``docs`` per group: that with the smallest id (nulls last), then the smallest digest of the text.
    Documents without words are groups of their own."""
    facts, named = _grouped(docs, id_col, text_col, k, num, den)
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    best = facts.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(own).alias("best"))
    best = best.join(named, "node").groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.key")
    best = best.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_i"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_k", F.xxhash64("_text")).withColumn("_words", F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    kept = rows.where("_words").join(best, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["_i", "_k"]).select("row.*").union(rows.where("not _words").select("row.*"))
