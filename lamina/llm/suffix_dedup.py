"""Removal of repeated substrings: hash-compared suffix sorting of the places where repeats begin and end.

A string of LENGTH bytes is removed wherever it also starts earlier. Each window of LENGTH bytes has an anchor,
the smallest hash of the GRAM-byte strings in it, which depends on the window's bytes alone; consecutive windows
with the same anchor are a run, and equal stretches of text have equal runs, but for those at their ends.

1. A task settles the repeats among its own texts before anything moves: runs of one digest are compared byte by byte, so
   that a run crosses the network once per task, however often it occurs. What moves then are digests and places.
2. Equal windows have their anchor at the same place, so they agree on 78 bytes around it, which ones the third of the
   window says that the anchor begins in (CELLS). A run moves with hashes of these, and its windows of a third are asked for
   with their bytes where another run has the same. They are gathered by anchor, and equal runs are found byte by
   byte. Of what differs, the suffixes that start the windows are sorted: prefix polynomial
   hashes and binary search find how far two suffixes agree, which makes a comparison logarithmic, and a bottom-up
   mergesort orders them. The order of neighbours is then verified byte by byte (a false agreement of hashes sends the
   bucket to a sort of the bytes themselves), and all but the earliest of equal windows are repeats.
3. Anchors of more than SPLIT different runs, such as those in a passage of under LENGTH bytes that very many texts hold,
   are not gathered: their thirds are dealt by the bytes around the anchor, and where more than SPLIT different runs share
   even these, their windows one by one, by their bytes, again once per task.
4. The windows found are joined into spans of each document and cut out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, row_of, settled, table, tune

#: Bytes of a string, and of the grams whose smallest hash is its anchor.
LENGTH, GRAM = 100, 32
#: Bytes that are hashed together; longer texts are taken in parts that overlap by LENGTH - 1.
PART = 1 << 19
#: Bytes of text whose runs a task settles together before it sends them.
TASK_BYTES = 24 << 20
#: Bytes of the input's files per bucket of runs, and bytes of runs whose suffixes are sorted together.
BUCKET_BYTES, SORTED_BYTES = 4 << 20, 1 << 20
#: Different runs of an anchor, or of the bytes around it, from which on they aren't gathered.
SPLIT = 64
#: Bits that tell anchors apart; the place of the anchor in a run is below DEALT, and how its cells are dealt above.
KIND_BITS, DEALT = 48, 256
#: Places of the anchor in a window, first and last of each class: windows of a class hold the LENGTH - (last - first) bytes from first before the anchor.
CELLS = ((0, 22), (23, 45), (46, LENGTH - GRAM))
#: How a cell of a run that isn't gathered by its anchor is dealt: not at all, by the bytes around the anchor, or by windows.
AROUND, SINGLY = 1, 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 20) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_CELL = tuple(f"c{i}" for i in range(len(CELLS)))
_POW, _INV = _powers(PART + 2 * LENGTH + 2, _BASE), _powers(PART + 2 * LENGTH + 2, pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Element i: polynomial of the first i bytes, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _POW[: len(data)], out=out[1:])
    return out


def _has(cell: int, mid: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether runs of so many windows, the first of which has its anchor at mid, have windows of a cell."""
    return (mid >= CELLS[cell][0]) & (mid - windows < CELLS[cell][1])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last window, place and class of the anchor of each run, and of each cell the hash of its bytes (0: it has no
    windows of the cell). ends: where each text in data ends."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + ([np.zeros(0, np.uint32) for _ in CELLS],)
    if n < LENGTH:
        return none
    h = prefix_hashes(data.astype(np.uint64))
    g = _mix((h[GRAM:] - h[:-GRAM]) * _INV[: n - GRAM + 1])
    v = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    width = LENGTH - GRAM + 1
    m, w = v, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if w < width:
        m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
    cut = np.zeros(n + 1, np.int32)  # windows that start in the last LENGTH - 1 bytes of a text reach into the next
    np.add.at(cut, np.maximum(ends - LENGTH + 1, np.r_[0, ends[:-1]]), 1)
    np.add.at(cut, ends, -1)
    valid = np.cumsum(cut)[: n - LENGTH + 1] == 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    a = m[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    anchor = (a[first] & _PLACE).astype(np.int64)
    lo, hi = at[first], at[last]
    cells = []
    for c, (low, high) in enumerate(CELLS):
        has = _has(c, anchor - lo, hi - lo + 1)
        begin, end = np.where(has, anchor - low, 0), np.where(has, anchor + LENGTH - high, 0)
        cells.append(np.where(has, _mix((h[end] - h[begin]) * _INV[begin]) >> np.uint64(32), 0).astype(np.uint32))
    return lo, hi, anchor, (g[anchor] * _ODD >> np.uint64(64 - KIND_BITS)).astype(np.int64), cells


def _parts(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts together up to PART bytes: bytes, ends, number of each text, its place in the text."""
    batch: list[tuple[bytes, int, int]] = []
    size = 0

    def flush():
        data = b"".join(x for x, _, _ in batch)
        return data, np.cumsum([len(x) for x, _, _ in batch]), np.array([i for _, i, _ in batch]), np.array([o for _, _, o in batch])

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        step = PART - LENGTH + 1
        for off in range(0, max(1, len(t) - LENGTH + 1), step):
            x = t[off : off + PART]
            if batch and size + len(x) > PART:
                yield flush()
                batch, size = [], 0
            batch.append((x, i, off))
            size += len(x)
    if batch:
        yield flush()


def text_runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All runs of texts: text, lo, hi (first and last window), mid (anchor less lo), kind, u (digest of the run's bytes), c0 to
    c2 (hashes of its cells)."""
    out: dict[str, list] = {k: [] for k in ("text", "lo", "hi", "mid", "kind", "u", *_CELL)}
    for data, ends, number, offset in _parts(texts):
        lo, hi, anchor, kind, cells = runs(np.frombuffer(data, np.uint8), ends)
        which = np.searchsorted(ends, lo, side="right")
        begin = np.r_[0, ends[:-1]][which]
        out["u"].append(np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())), np.uint64, len(lo)))
        out["text"].append(number[which])
        out["lo"].append((lo - begin + offset[which]).astype(np.int32))
        out["hi"].append((hi - begin + offset[which]).astype(np.int32))
        out["mid"].append(anchor - lo)
        out["kind"].append(kind)
        for name, x in zip(_CELL, cells):
            out[name].append(x)
    types = {"text": np.int64, "lo": np.int32, "hi": np.int32, "mid": np.int16, "kind": np.int64, "u": np.uint64} | dict.fromkeys(_CELL, np.uint32)
    return {k: np.concatenate([*v, np.zeros(0, types[k])]).astype(types[k]) for k, v in out.items()}


def _take(d: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in d.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in the order of the keys, the first one leading; equal rows in a row's own order."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def settle(r: dict[str, np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs and the rank of their texts, by digest: first of equal runs; the others; the first of each of those."""
    o = np.lexsort((r["lo"], rank, r["u"], r["kind"]))
    if not len(o):
        return o, o, o
    k, u = r["kind"][o], r["u"][o]
    new = np.r_[True, (k[1:] != k[:-1]) | (u[1:] != u[:-1])]
    first = o[new]
    return first, o[~new], first[np.cumsum(new)[~new] - 1]


def _counts(u: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row how many rows, and how many different u, have its keys."""
    o = np.lexsort((u, *keys))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[o][1:] != k[o][:-1]
    other = new.copy()
    other[1:] |= u[o][1:] != u[o][:-1]
    first, which = np.flatnonzero(new), np.cumsum(new) - 1
    rows, different = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
    if len(o):
        rows[o] = np.diff(np.r_[first, len(o)])[which]
        different[o] = np.add.reduceat(other.astype(np.int64), first)[which]
    return rows, different


def _blob(d: dict[str, np.ndarray | bytes]) -> bytes:
    """Numbers by the planes of their bytes, most of which hold the same byte again and again: Spark packs these well."""
    planes = lambda v: v if isinstance(v, bytes) else (v.dtype.str, np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T.tobytes())
    return pickle.dumps({k: planes(v) for k, v in d.items()}, protocol=5)


def _unblob(x: bytes) -> dict[str, np.ndarray | bytes]:
    def numbers(v):
        if isinstance(v, bytes):
            return v
        kind = np.dtype(v[0])
        return np.ascontiguousarray(np.frombuffer(v[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()

    return {k: numbers(v) for k, v in pickle.loads(x).items()}


def _dealt(d: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of d by bucket."""
    o = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[o], return_index=True)
    for b, lo, hi in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(o)]):
        yield b, _blob(_take(d, o[lo:hi]))


def _doc_bucket(d: dict[str, np.ndarray], n: int) -> np.ndarray:
    return (_mix(d["file"].view(np.uint64) + _mix(d["at"].view(np.uint64))) % np.uint64(n)).astype(np.int64)


_ROWS = ("file", "at", "lo", "hi")
digest = xxhash.xxh3_64_intdigest


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "data"])


def _send_runs(texts: list[bytes], ids: np.ndarray, file: np.ndarray, at: np.ndarray, buckets: int, doc_buckets: int) -> list[tuple[int, bytes]]:
    r = text_runs(texts)
    t = r.pop("text")
    first, again, to = settle(r, _rank(ids, file, at)[t])
    lo, end = r["lo"].tolist(), (r["hi"] + LENGTH).tolist()
    number = t.tolist()
    same = np.fromiter((texts[number[i]][lo[i] : end[i]] == texts[number[j]][lo[j] : end[j]] for i, j in zip(again.tolist(), to.tolist())), bool, len(again))
    if not same.all():  # a collision of digests: these go on as different ones, and meet their equals by their bytes
        first, again = np.r_[first, again[~same]], again[same]
        odd = first[-int((~same).sum()) :]
        r["u"][odd] = odd.astype(np.uint64)
    # those with the same cells together, as what they lack then packs well
    first = first[np.lexsort((first, *(r[c][first] == 0 for c in _CELL)))]
    own = _take(r, first) | {"file": file[t[first]], "at": at[t[first]]}
    own["u"] = own["u"].astype(np.uint16)  # it now but counts different runs
    out = list(_dealt(own, own["kind"] % buckets))
    return out + _known(file[t[again]], at[t[again]], r["lo"][again], r["hi"][again], doc_buckets)


def _known(file: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc_buckets: int) -> list[tuple[int, bytes]]:
    """Repeats for buckets of documents, under negative numbers: they pass the buckets of runs."""
    d = {"file": file, "at": at, "lo": lo, "hi": hi, "kind": np.zeros(len(lo), np.int64), "mid": np.full(len(lo), -1, np.int16)}
    return [(-1 - b, x) for b, x in _dealt(d, _doc_bucket(d, doc_buckets))]


def _passed(t: pa.Table, bucket: int) -> pa.Table:
    return pa.Table.from_batches([_batch([(-1 - bucket, _blob(_joined([_unblob(x.as_py()) for x in t.column("data")])))])])


def _compare_runs(t: pa.Table, doc_buckets: int) -> pa.Table:
    """Runs of a bucket, one of each digest per task, to questions for buckets of documents: the windows of cells that they
    share with others, as equal windows do."""
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        return _passed(t, bucket)
    r = _joined([_unblob(x.as_py()) for x in t.column("data")])
    n, mid = (r["hi"] - r["lo"]).astype(np.int64) + 1, r["mid"].astype(np.int64)
    how = np.zeros((len(CELLS), len(n)), np.int64)
    for c, name in enumerate(_CELL):
        at = np.flatnonzero(_has(c, mid, n))
        rows, different = _counts(r["u"][at], r[name][at], r["kind"][at])
        how[c, at] = np.where(rows > 1, np.where(different > SPLIT, SINGLY, AROUND), 0)
    wanted = np.flatnonzero(how.any(0))
    r, n, mid, how = _take(r, wanted), n[wanted], mid[wanted], how[:, wanted]
    low = np.min([np.where(x > 0, a, LENGTH) for x, (a, _) in zip(how, CELLS)], axis=0)
    high = np.max([np.where(x > 0, b, 0) for x, (_, b) in zip(how, CELLS)], axis=0)
    begin, end = np.maximum(0, mid - high), np.minimum(n - 1, mid - low)
    hot = _counts(r["u"], r["kind"])[1] > SPLIT
    dealt = np.where(hot, sum(x << 2 * c for c, x in enumerate(how)), 0)
    asks = {"file": r["file"], "at": r["at"], "lo": (r["lo"] + begin).astype(np.int32), "hi": (r["lo"] + end).astype(np.int32), "kind": r["kind"], "mid": (mid - begin + DEALT * dealt).astype(np.int16)}
    return pa.Table.from_batches([_batch(list(_dealt(asks, _doc_bucket(asks, doc_buckets))))])


def _by_document(t: pa.Table) -> pa.Table:
    """Of a bucket of documents: a row per document with its repeats and its questions."""
    r = _joined([_unblob(x.as_py()) for x in t.column("data")])
    o = np.lexsort((r["lo"], r["at"], r["file"]))
    r = _take(r, o)
    cut = np.flatnonzero(np.r_[True, (r["file"][1:] != r["file"][:-1]) | (r["at"][1:] != r["at"][:-1])])
    spans, asks = [], []
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(o)]):
        q = r["mid"][lo:hi] >= 0
        spans.append(np.stack([r["lo"][lo:hi], r["hi"][lo:hi]], 1)[~q].astype("<i4").tobytes())
        asks.append(np.stack([r["lo"][lo:hi], r["hi"][lo:hi], r["mid"][lo:hi].astype(np.int64), r["kind"][lo:hi].astype(np.int64)], 1)[q].astype("<i8").tobytes())
    return pa.table({"file": pa.array(r["file"][cut]), "at": pa.array(r["at"][cut]), "spans": pa.array(spans, pa.binary()), "asks": pa.array(asks, pa.binary())})


class Suffixes:
    """Windows of a buffer, compared through prefix hashes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data) + 1
        self.inverse = _powers(n + 1, pow(_BASE, -1, 1 << 64))
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * _powers(n, _BASE)[:-1], out=self.prefix[1:])

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of bytes, LENGTH at most, on which the suffixes at a and b agree: binary search on hashes."""
        ia, ib, ha, hb = self.inverse[a], self.inverse[b], self.prefix[a], self.prefix[b]
        out = np.zeros(len(a), np.int64)
        step = 1 << LENGTH.bit_length() - 1
        while step:
            t = out + step
            ok = t <= LENGTH
            t = np.where(ok, t, 0)
            ok &= (self.prefix[a + t] - ha) * ia == (self.prefix[b + t] - hb) * ib
            out = np.where(ok, t, out)
            step //= 2
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the window at a comes before the one at b; equal ones do where ties says so."""
        l = self.agree(a, b)
        same = l == LENGTH
        l = np.where(same, 0, l)
        return np.where(same, ties, self.data[a + l] < self.data[b + l])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of windows (in order of group) that sorts each group: bottom-up mergesort, stable.

        In each round an element's new place is its place among its block plus the number of elements of the
        neighbouring block that come before it, found by binary search; all blocks of all groups at once.
        """
        n = len(at)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:n])
        size = np.diff(np.r_[first, n])
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        width = 1
        live = np.flatnonzero(end - begin > 1)
        while len(live):
            p = live  # places
            r = p - begin[p]
            block = r // width
            right = block % 2 == 1
            lo = begin[p] + np.where(right, block - 1, block + 1) * width
            lo = np.minimum(lo, end[p])
            hi = np.minimum(lo + width, end[p])
            start, mine = lo.copy(), at[order[p]]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                # of equal windows those of the left block come first
                less = self.before(at[order[mid]], mine[open_], right[open_])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            target = begin[p] + (block - block % 2) * width + (r % width) + (lo - start)
            new = order.copy()
            new[target] = order[p]
            order = new
            width *= 2
            live = live[(end - begin)[live] > width]
        return order

    def order(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte by byte: whether the windows at a and b are equal, and whether the one at a comes after that at b."""
        equal, after = np.ones(len(a), bool), np.zeros(len(a), bool)
        open_ = np.arange(len(a))
        for i in range(LENGTH):
            x, y = self.data[a[open_] + i], self.data[b[open_] + i]
            after[open_[x > y]] = True
            equal[open_[x != y]] = False
            open_ = open_[x == y]
            if not len(open_):
                break
        return equal, after


def repeated_windows(q: dict[str, np.ndarray], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of questions (runs of a bucket with their bytes one after another): question and window of each repeat."""
    sizes = (q["hi"] - q["lo"]).astype(np.int64) + 1
    length = sizes + LENGTH - 1
    base = np.cumsum(length) - length
    rank = _rank(q["id"], q["file"], q["at"])
    # whole runs first: of equal ones, by their bytes, all but the earliest repeat
    kind, mid, begin, end = q["kind"].tolist(), q["mid"].tolist(), base.tolist(), (base + length).tolist()
    last, seen = None, {}
    again, alike, now = [], [], []
    for i in np.lexsort((q["lo"], rank, q["kind"])).tolist():
        if kind[i] != last:
            if len(now) > 1:
                alike += now
            last, seen, now = kind[i], {}, []
        if seen.setdefault((mid[i], data[begin[i] : end[i]]), i) == i:
            now.append(i)
        else:
            again.append(i)
    if len(now) > 1:
        alike += now  # different runs of an anchor
    whole = np.array(again, np.int64)
    owns, starts = [np.repeat(whole, sizes[whole])], [_ramp(sizes[whole]) + np.repeat(q["lo"][whole], sizes[whole])]
    edges = [i for i, x in enumerate(alike) if i == 0 or kind[x] != kind[alike[i - 1]]] + [len(alike)]
    part: list[int] = []
    for lo, hi in zip(edges, edges[1:]):
        part += alike[lo:hi]
        if hi == len(alike) or length[part].sum() > SORTED_BYTES:
            own = np.array(part, np.int64)
            found, start = _sorted_repeats(_take(q, own), rank[own], b"".join(data[begin[i] : end[i]] for i in part))
            owns.append(own[found])
            starts.append(start)
            part = []
    return np.concatenate(owns), np.concatenate(starts)


def _sorted_repeats(q: dict[str, np.ndarray], rank: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of runs that differ, by sorting the suffixes that start their windows."""
    sizes = (q["hi"] - q["lo"]).astype(np.int64) + 1
    base = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
    own = np.repeat(np.arange(len(sizes)), sizes)
    j = _ramp(sizes)
    # equal windows have their anchor at the same place
    key = q["kind"][own] << 8 | (q["mid"].astype(np.int64)[own] - j)
    o = np.lexsort((j + q["lo"][own], rank[own], key))
    own, j, key = own[o], j[o], key[o]
    alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
    own, j, key = own[~alone], j[~alone], key[~alone]
    if not len(key):
        return own, j
    at = base[own] + j
    s = Suffixes(data)
    order = s.sort(at, key)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(key[a] == key[b])
    equal, after = s.order(at[a[near]], at[b[near]])
    real = np.zeros(len(a), bool)
    real[near] = equal
    if after.any():  # hashes agreed where bytes don't: sort by the bytes themselves
        windows = [(k, data[x : x + LENGTH], i) for i, (k, x) in enumerate(zip(key.tolist(), at.tolist()))]
        windows.sort()
        order = np.array([i for _, _, i in windows])
        real = np.array([x[:2] == y[:2] for x, y in zip(windows, windows[1:])], bool)
    later = order[1:][real]  # the first of equal windows is the earliest
    return own[later], j[later] + q["lo"][own[later]]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spans(file: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow one another in a document as first and last: file, at, lo, hi."""
    o = np.lexsort((start, at, file))
    file, at, start = file[o], at[o], start[o]
    new = np.r_[True, (file[1:] != file[:-1]) | (at[1:] != at[:-1]) | (start[1:] > start[:-1] + 1)][: len(o)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(o)] - 1 if len(first) else first
    return file[first], at[first], start[first].astype(np.int32), start[last].astype(np.int32)


def _apart(q: dict[str, np.ndarray], pieces: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Cells of runs as questions of their own, or their windows, each under a class of its bytes, and their bytes; of those
    that are equal here only the earliest. The question and start of the others' windows."""
    seen: set[tuple[int, int, bytes]] = set()
    own, lo, hi, place, kind, data, again, start = [], [], [], [], [], [], [], []
    rank = _rank(q["id"], q["file"], q["at"])
    for i in np.lexsort((q["lo"], rank)).tolist():
        k, mid, first, last = int(q["kind"][i]), int(q["mid"][i]) % DEALT, int(q["lo"][i]), int(q["hi"][i])
        for c, (low, high) in enumerate(CELLS):
            how = int(q["mid"][i]) // DEALT >> 2 * c & 3
            if not how:
                continue
            j, end = max(0, mid - high), min(last - first, mid - low)
            step = 1 if how == SINGLY else end - j + 1
            for j in range(j, end + 1, step):
                w = pieces[i][j : j + step - 1 + LENGTH]
                if (k, mid - j, w) in seen:
                    again += [i] * step
                    start += range(first + j, first + j + step)
                    continue
                seen.add((k, mid - j, w))
                own.append(i)
                lo.append(first + j)
                hi.append(first + j + step - 1)
                place.append(mid - j)
                around = w if how == SINGLY else pieces[i][mid - low : mid + LENGTH - high]
                kind.append(xxhash.xxh64_intdigest(around, (k * 128 + (mid - j if how == SINGLY else LENGTH + c)) % (1 << 64)) >> (64 - KIND_BITS))
                data.append(w)
    out = _take(q, np.array(own, np.int64))
    out |= {"lo": np.array(lo, np.int32), "hi": np.array(hi, np.int32), "mid": np.array(place, np.int16), "kind": np.array(kind, np.int64)}
    return out, data, np.array(again, np.int64), np.array(start, np.int64)


def questions(fields: list[np.ndarray], pieces: list[bytes], buckets: int) -> list[tuple[int, bytes]]:
    """Rows (lo, hi, mid, kind, id, file, at) and their bytes, for buckets of anchors; those not to be gathered, by cells or windows."""
    f = np.concatenate(fields)
    d = {"lo": f[:, 0].astype(np.int32), "hi": f[:, 1].astype(np.int32), "mid": f[:, 2].astype(np.int16), "kind": f[:, 3], "id": f[:, 4], "file": f[:, 5], "at": f[:, 6]}
    data, out = pieces, []
    dealt = np.flatnonzero(d["mid"] >= DEALT)
    if len(dealt):
        hot = _take(d, dealt)
        new, more, again, start = _apart(hot, [pieces[i] for i in dealt.tolist()])
        out = _known(*_spans(hot["file"][again], hot["at"][again], start), buckets)
        rest = np.flatnonzero(d["mid"] < DEALT)
        d = _joined([_take(d, rest), new])
        data = [pieces[i] for i in rest.tolist()] + more
    order = np.argsort(d["kind"] % buckets, kind="stable")
    bucket = (d["kind"] % buckets)[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(order)])
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        own = order[lo:hi]
        out.append((int(bucket[lo]), _blob(_take(d, own) | {"bytes": b"".join(data[i] for i in own.tolist())})))
    return out


def _answer(t: pa.Table, doc_buckets: int) -> pa.Table:
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        return _passed(t, bucket)
    parts = [_unblob(x.as_py()) for x in t.column("data")]
    data = b"".join(p.pop("bytes") for p in parts)
    q = _joined(parts)
    own, start = repeated_windows(q, data)
    file, at, lo, hi = _spans(q["file"][own], q["at"][own], start)
    return pa.Table.from_batches([_batch([(-1 - b, x) for b, x in _known(file, at, lo, hi, doc_buckets)])])


def cut(text: bytes, windows: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal spans that the windows (first, last of each row) cover, and the bytes outside them."""
    if not len(windows):
        return [], text
    w = windows[np.argsort(windows[:, 0], kind="stable")]
    start, end = w[:, 0], np.maximum.accumulate(w[:, 1] + LENGTH)
    new = np.r_[True, start[1:] > end[:-1]]
    spans = list(zip(start[new].tolist(), end[np.r_[np.flatnonzero(new)[1:] - 1, len(w) - 1]].tolist()))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return spans, b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes long, spans array<struct<start, end>> of bytes removed, kept binary.

    Earlier means smaller doc_id (null first) in Spark's order of its type, then, of repeated ids, place in the table,
    then place in the text. Null and empty texts, and texts under LENGTH bytes, have no spans. Repeated rows and rows
    of a null id are rows of their own; an empty table gives an empty result. Only id and text are read.
    """
    docs = settled(docs.select(id_col, text_col))
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    columns = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        columns = columns.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    else:  # a number in the order of the ids: of the range that a task sorts, and the place in it
        ranks = columns.select("row", "doc_id").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
        ranks = scratch.keep(ranks.select("row", F.monotonically_increasing_id().alias("id")), True)
        columns = columns.join(ranks, "row")
    texts = columns.select(F.col("row.file").alias("file"), F.col("row.at").alias("at"), "id", "doc_id", "text")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # Spark's stand-in for sizes that it doesn't know is beyond it
    buckets = max(12, -(-size // BUCKET_BYTES) if known else int(spark.conf.get("spark.sql.shuffle.partitions")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(group)
            group.clear()
            ids, file, at = (t.column(c).to_numpy() for c in ("id", "file", "at"))
            return _batch(_send_runs(t.column("text").to_pylist(), ids, file, at, buckets, buckets))

        for b in batches:
            group.append(b)
            if sum(x.nbytes for x in group) >= TASK_BYTES:
                yield flush()
        if group:
            yield flush()

    rows = "bucket int, data binary"
    sent = texts.select("file", "at", "id", "text").mapInArrow(send, rows)
    compared = sent.groupBy("bucket").applyInArrow(lambda t: _compare_runs(t, buckets), rows)
    state = scratch.keep(compared.groupBy("bucket").applyInArrow(_by_document, "file long, at long, spans binary, asks binary"), True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list[np.ndarray] = []
        pieces: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = _batch(questions(fields, pieces, buckets))
            fields.clear()
            pieces.clear()
            return out

        for b in batches:
            for i, (q, text) in enumerate(zip(b.column("asks").to_pylist(), b.column("text").to_pylist())):
                q = np.frombuffer(q, "<i8").reshape(-1, 4)
                own = np.array([[b.column(c)[i].as_py() for c in ("id", "file", "at")]], np.int64)
                fields.append(np.hstack([q, np.repeat(own, len(q), 0)]))
                new = [text[lo : hi + LENGTH] for lo, hi in q[:, :2].tolist()]
                pieces.extend(new)
                size += sum(map(len, new))
            if size >= TASK_BYTES:
                yield flush()
                size = 0
        if fields:
            yield flush()

    asking = texts.drop("doc_id").join(state.where("octet_length(asks) > 0").select("file", "at", "asks"), ["file", "at"])
    answered = asking.select("file", "at", "id", "asks", "text").mapInArrow(ask, rows).groupBy("bucket").applyInArrow(lambda t: _answer(t, buckets), rows)
    more = answered.groupBy("bucket").applyInArrow(_by_document, "file long, at long, spans binary, asks binary").select("file", "at", F.col("spans").alias("more"))
    none = F.lit(b"").cast("binary")
    spans = state.where("octet_length(spans) > 0").select("file", "at", "spans").join(more, ["file", "at"], "full")
    spans = scratch.keep(spans.select("file", "at", F.concat(F.coalesce("spans", none), F.coalesce("more", none)).alias("spans")), True)
    scratch.drop(state)
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            done = [cut(t, np.frombuffer(w or b"", "<i4").reshape(-1, 2)) for t, w in zip(texts, b.column(2).to_pylist())]
            spans = pa.array([[{"start": a, "end": e} for a, e in s] for s, _ in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), spans, pa.array([k for _, k in done], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    out = texts.drop("id").join(spans, ["file", "at"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(apply, f"doc_id {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary").withColumnRenamed("doc_id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.octet_length("kept").cast("long")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
