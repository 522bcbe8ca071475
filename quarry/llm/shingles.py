"""Vectorised hashes of words and word shingles in Arrow batches of texts.

Everything works on slices of about ``SLICE`` bytes, so memory doesn't follow the batch; a single longer text is
hashed piece by piece and only keeps 8 bytes per word. Hashes have 64 bits: sets of shingles are held and compared
by them.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20
U = np.uint64
_BASE, _M1, _M2, _M3 = U(0x9E3779B97F4A7C15 | 1), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (two rounds of xor-shift and multiply); a bijection."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(29))
    x = x * _M2
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * _M3)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes outside ASCII letters, digits and the bytes of other characters.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict = {}


def powers(n: int):
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if n > len(_POWERS.get("p", ())):
        size = max(n, SLICE + 4096)
        inv = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS["p"] = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE, U)]), dtype=U)
            _POWERS["q"] = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(inv), U)]), dtype=U)
    return _POWERS["p"], _POWERS["q"]


def buffers(column):
    """``(bytes, offsets)`` of an Arrow string column without nulls, as NumPy views."""
    import pyarrow as pa
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges ``(i, j)`` of rows of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _hash_piece(low: np.ndarray, first: np.ndarray, gaps: np.ndarray):
    """Starts, ends and hashes of the words of one piece; ``first`` marks the first bytes of texts."""
    word = ~gaps[low]
    prev = np.empty_like(word)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | first))
    after = np.empty_like(word)
    after[-1] = True
    after[:-1] = ~word[1:] | first[1:]
    ends = np.flatnonzero(word & after) + 1
    p, q = powers(len(low))
    h = np.empty(len(low) + 1, U)
    h[0] = 0
    np.cumsum(_BYTE[low] * p[:len(low)], out=h[1:])
    return starts, ends, mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(U) * _M3)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES):
    """``(hashes, text number, start)`` of the lower-cased (A-Z) words of the texts ``offsets`` cuts from ``data``;
    ``gaps`` marks the bytes between words."""
    a, z = int(offsets[0]), int(offsets[-1])
    hs, ts, ss = [], [], []
    at = a
    while at < z:
        end = min(at + SLICE, z)
        if end < z:  # to the next text or gap, so that no word is cut
            k = int(np.searchsorted(offsets, end))
            stop, step = int(offsets[k]), end
            while step < stop:
                gap = np.flatnonzero(gaps[data[step:min(step + 65536, stop)]])
                if len(gap):
                    stop = step + int(gap[0])
                    break
                step += 65536
            end = stop
        low = LOWER[data[at:end]]
        first = np.zeros(len(low), bool)
        begun = offsets[(offsets >= at) & (offsets < end)] - at
        first[begun] = True
        s, _, h = _hash_piece(low, first, gaps)
        hs.append(h)
        ss.append(s + at)
        ts.append(np.searchsorted(offsets, s + at, side="right") - 1)
        at = end
    if not hs:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ts), np.concatenate(ss)


def shingles(hashes: np.ndarray, texts: np.ndarray, k: int):
    """``(shingle hashes, text number)``: every run of ``k`` words of a text; a shorter text gives its whole sequence."""
    n = len(hashes)
    c = mix(np.arange(1, k + 1, dtype=U) * _M3) | U(1)
    out_h, out_t = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= k:
        acc = np.zeros(n - k + 1, U)
        for j in range(k):
            acc += mix(hashes[j:n - k + 1 + j] + U(j)) * c[j]
        ok = texts[:n - k + 1] == texts[k - 1:]
        out_h, out_t = mix(acc[ok]), texts[:n - k + 1][ok]
    ids, begin, size = np.unique(texts, return_index=True, return_counts=True)
    short = np.flatnonzero(size < k)
    if len(short):
        extra = np.empty(len(short), U)
        for x, s in enumerate(short):
            m = int(size[s])
            part = hashes[begin[s]:begin[s] + m]
            extra[x] = mix((mix(part + np.arange(m, dtype=U)) * c[:m]).sum(dtype=U, keepdims=True) + np.full(1, m, U) * _M1)[0]
        out_h = np.concatenate([out_h, extra])
        out_t = np.concatenate([out_t, ids[short]])
        order = np.argsort(out_t, kind="stable")
        out_h, out_t = out_h[order], out_t[order]
    return out_h, out_t


def shingle_sets(column, k: int):
    """Yields ``(row, sorted distinct shingle hashes)`` for the rows of an Arrow text column, slice by slice."""
    data, off = buffers(column)
    for i, j in slices(off):
        h, t, _ = word_hashes(data, off[i:j + 1])
        sh, st = shingles(h, t, k)
        cuts = np.searchsorted(st, np.arange(j - i + 1))
        for r in range(j - i):
            part = sh[cuts[r]:cuts[r + 1]]
            if len(part) > 1:
                part = np.sort(part)
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            yield i + r, part
