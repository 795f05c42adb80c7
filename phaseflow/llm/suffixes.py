"""Suffix-array dedup of exact passages.

Every byte that lies in a ``WINDOW``-byte string which also starts in a document with a smaller id is removed. Texts
are UTF-8 bytes; strings never cross documents and are judged on the input.

A suffix for every byte would be dozens of times the input, so the array is sparse, without losing a match: among the
``GRAM``-byte strings of each window the one with the least hash is its anchor (the first of equals), which depends on
the window alone, so equal windows have equal anchors at equal places. One anchor serves the run of windows around it;
in prose about one in sixteen bytes is one, and only suffixes that start at anchors are kept, each with the bytes before
it that its windows reach. Text that repeats itself has more anchors (a run of one character has one a byte), but their
suffixes are equal, and a document has each of its suffixes once a segment, with the list of its places.

0. Rows of one text are one: its least id stands for all, and of the others everything goes if there is a window at all.
   So a text costs the same however many copies it has.
1. Filter: anchors whose gram occurs in one text only are dropped. Their hashes go out in packed blocks, dealt by hash; a
   block has each hash once, so a passage that a third of all documents share is not sent again and again.
2. Equal suffixes (with the bytes before them) become one with the least id, summed up map-side.
3. Sampled splitters range-partition the suffixes by their leading bytes and then by the bytes before them, so even
   equal suffixes with different bytes before them are split. Each partition sorts by multikey quicksort, finds the
   least id for each window of each suffix from common prefixes, and leaves the windows whose prefix the partition's
   first or last suffix shares to a comparison across boundaries: hashes of these go out in packed blocks.
4. Windows with a smaller id elsewhere become intervals, collected per document and cut out of its text.

Inside a partition bytes are compared. Elsewhere hashes stand for them: 128 bits for equal texts, for windows at boundaries
and for suffixes that are joined with their documents; 64 bits for the grams of the filter, where a collision costs
nothing, and for the texts that it tells apart, where one would hide passages that those two texts alone share.

Memory: texts go through in segments of ``SEGMENT`` bytes; partitions are as many as ``PART_BYTES`` of text and
``PART_SUFFIXES`` suffixes ask for, and more if the session says so.

Cases: a null or empty text is empty; a text shorter than a window keeps everything; rows with one id count as one
document and do not remove from each other, each keeps its own text; rows with a null id are compared with nothing; an
empty table gives an empty result; characters that a cut parts are left out of the text that is put out; extra columns
stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseflow.llm import worker
from phaseflow.llm.scratch import dropped, written

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1
#: Bytes that are hashed together, and anchors whose hashes are packed together.
SEGMENT, BLOCK = 1 << 20, 1 << 19
#: Bytes of text, and suffixes, that a task is to hold at most on average.
PART_BYTES, PART_SUFFIXES = 1 << 26, 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
#: Runs that a partition step leaves to a library sort.
SMALL = 64

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
worker.keeps("suffixes", _powers.clear)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    worker.enter("suffixes")
    if n not in _powers:
        power = np.full(n, BASE, np.uint64)
        power[0] = 1
        inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _powers[n] = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    return _powers[n]


def _anchors_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, hash) over at most a segment of bytes."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    power, inverse = _power_tables(SEGMENT + WINDOW)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])))
    gram = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(29)
    low = np.uint64((1 << 22) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPAN:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    windows = n - WINDOW + 1
    at = (np.minimum(least[:windows], least[SPAN - reach : SPAN - reach + windows]) & low).astype(np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    new[starts[starts < windows]] = True
    past = np.maximum(ends - WINDOW + 1, starts)
    new[past[past < windows]] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [windows])) - 1
    doc = np.searchsorted(starts, first, "right") - 1
    whole = first + WINDOW <= ends[doc]
    first, last, doc = first[whole], last[whole], doc[whole]
    return doc, at[first], first, last, gram[at[first]]


def segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, anchor, first window, last window, hash), in order, about a segment of bytes at a time; places are in
    bytes of ``data``. ``bounds`` are the documents' starts and the last one's end."""
    starts, ends = bounds[:-1], bounds[1:]
    keep = np.flatnonzero(ends - starts >= WINDOW)
    at = 0
    while at < len(keep):
        a = keep[at]
        if ends[a] - starts[a] > SEGMENT:
            for begin in range(int(starts[a]), int(ends[a]) - WINDOW + 1, SEGMENT):
                end = min(begin + SEGMENT + WINDOW - 1, int(ends[a]))
                doc, *places, h = _anchors_of(data[begin:end], np.array([0]), np.array([end - begin]))
                yield doc + a, *(p + begin for p in places), h
            at += 1
            continue
        stop = at + max(1, int(np.searchsorted(ends[keep[at:]], starts[a] + SEGMENT, "right")))
        some, begin = keep[at:stop], int(starts[a])
        doc, *places, h = _anchors_of(data[begin : int(ends[some[-1]])], starts[some] - begin, ends[some] - begin)
        yield some[doc], *(p + begin for p in places), h
        at = stop


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """All of :func:`segments` at once."""
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none, none, none, none.astype(np.uint64)), *segments(data, bounds), strict=True))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the rows' bounds; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Little-endian bytes of ``values`` parted into runs of ``counts``."""
    raw = np.ascontiguousarray(values)
    offsets = np.concatenate(([0], np.cumsum(counts))) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


HASHES = "bucket int, known boolean, docs binary, counts binary, hashes binary"


def _hashes(buckets: int):
    """Rows (h, text) to packed hashes: of each hash in a block once, and all of those that it has in two documents."""

    def block(ids: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, h))
        ids, h = ids[order], h[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(h)])) - 1
        several = (ids[first] != ids[last])[run]
        for known, pick in ((False, first), (True, np.flatnonzero(several))):
            if not len(pick):
                continue
            b = ((h[pick] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((ids[pick], b))
            b, i, x = b[order], ids[pick][order], h[pick][order]
            cut = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
            rows = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                docs, counts = np.unique(i[lo:hi], return_counts=True)
                rows.append({"bucket": int(b[lo]), "known": known, "docs": docs.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "hashes": x[lo:hi].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hs, n = [], [], 0
        for batch in batches:
            data, bounds = _bytes(batch.column(1))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, _, _, _, h in segments(data, bounds):
                ids.append(own[doc])
                hs.append(h)
                n += len(h)
                if n >= BLOCK:
                    yield from block(np.concatenate(ids), np.concatenate(hs))
                    ids, hs, n = [], [], 0
        if n:
            yield from block(np.concatenate(ids), np.concatenate(hs))

    return run


def _shared(buckets: int):
    """Packed hashes of whole buckets to those that two documents have or are known to have, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hs, sure = [], [], []
        for batch in batches:
            for known, (d, h) in zip(batch.column("known").to_pylist(), _unpacked(batch), strict=True):
                docs.append(d)
                hs.append(h)
                sure.append(np.full(len(h), known))
        if not docs:
            return
        doc, h, sure = np.concatenate(docs), np.concatenate(hs), np.concatenate(sure)
        order = np.lexsort((doc, h))
        doc, h, sure = doc[order], h[order], sure[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(h)])) - 1
        keep = sure | (doc[first] != doc[last])[np.cumsum(new) - 1]
        doc, h = doc[keep], h[keep]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(doc):
            distinct = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
            doc, h = doc[distinct], h[distinct]
        yield from _by_bucket(doc, h, buckets)

    return run


def _by_bucket(doc: np.ndarray, h: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Hashes packed by document, a row for each bucket of documents."""
    b = (doc.view(np.uint64) * np.uint64(BASE) >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((h, doc, b))
    b, doc, h = b[order], doc[order], h[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, int)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        docs, counts = np.unique(doc[lo:hi], return_counts=True)
        row = {"bucket": int(b[lo]), "docs": docs.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "hashes": h[lo:hi].tobytes()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]))


def _unpacked(batch: pa.RecordBatch, names: tuple[str, ...] = ("docs", "counts", "hashes")) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for d, c, h in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
        yield np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)), np.frombuffer(h, np.uint64)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of whole buckets to (h, hashes), a row a text, hashes in order."""
    parts = [x for batch in batches for x in _unpacked(batch)]
    if not parts:
        return
    doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    ids, counts = np.unique(doc, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for at in range(0, len(ids), 1 << 12):
        part = slice(at, at + (1 << 12))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), _list(h[ends[at] : ends[min(len(ids), at + (1 << 12))]], counts[part])], ["h", "hashes"])


def _once(data: np.ndarray, doc: np.ndarray, back: np.ndarray, first: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each context of a segment the first one of its document that is the same; only contexts with equal anchors can
    be, so others are not looked at."""
    same = np.arange(len(doc))
    order = np.lexsort((same, size, back, h, doc))
    alike = np.zeros(len(doc), bool)
    alike[1:] = (np.diff(doc[order]) == 0) & (h[order][1:] == h[order][:-1]) & (np.diff(back[order]) == 0) & (np.diff(size[order]) == 0)
    run = np.cumsum(~alike)
    lead = order[np.searchsorted(run, run, "left")]
    rest = order[lead != order]
    lead = lead[lead != order]
    for lo in range(0, len(rest), 1 << 14):
        a, b, n = rest[lo : lo + (1 << 14)], lead[lo : lo + (1 << 14)], size[rest[lo : lo + (1 << 14)]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = np.logical_and.reduceat(data[np.repeat(first[a], n) + at] == data[np.repeat(first[b], n) + at], np.cumsum(n) - n)
        same[a[equal]] = b[equal]
    return same


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, shared hashes, h) to suffixes: (id, h, places, back, context).

    ``context`` is the text that the anchor's windows cover, from each of the bytes ``places`` of the text; the suffix
    starts ``back`` bytes into it.
    """
    for batch in batches:
        data, bounds = _bytes(batch.column(1))
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
        for doc, at, first, last, h in segments(data, bounds):
            keep = np.zeros(len(doc), bool)
            for k in np.unique(doc).tolist():
                lo, hi = np.searchsorted(doc, (k, k + 1)).tolist()
                place = np.minimum(np.searchsorted(lists[k], h[lo:hi]), len(lists[k]) - 1)
                keep[lo:hi] = lists[k][place] == h[lo:hi]
            doc, at, first, last, h = (x[keep] for x in (doc, at, first, last, h))
            if not len(doc):
                continue
            back, size = at - first, last - first + WINDOW
            same = _once(data, doc, back, first, size, h)
            order = np.argsort(same, kind="stable")
            lead, count = np.unique(same, return_counts=True)
            ends = np.concatenate(([0], np.cumsum(count)))
            places = (first - bounds[doc])[order]
            for lo in range(0, len(lead), 1 << 15):
                hi = min(len(lead), lo + (1 << 15))
                some = lead[lo:hi]
                n = size[some]
                end = np.cumsum(n)
                raw = data[np.repeat(first[some] - end + n, n) + np.arange(end[-1])]
                own = pa.array(doc[some])
                lists_of = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(places[ends[lo] : ends[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(3).take(own), lists_of, pa.array(back[some].astype(np.int32)), _list(raw, n)], ["id", "h", "places", "back", "context"])


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words, by word: three-way partition around a pivot, the equal part by the next word."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        rows = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[:: max(1, len(key) // 15)])[min(7, (len(key) - 1) // 2)]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate((rows[less], rows[~(less | more)], rows[more]))
        stack += [(lo, lo + a, depth), (lo + a, hi - b, depth + 1), (hi - b, hi, depth)]
    return order


def _padded(data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes, zeros past ``size``; with ``back`` read towards lower places from ``starts`` - 1."""
    k = np.arange(width)
    at = (starts[:, None] - 1 - k) if back else (starts[:, None] + k)
    inside = k < size[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)


RIGHT, LEFT = 80, 32


def least_ids(data: np.ndarray, starts: np.ndarray, back: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes, by window (row-major, 31 to a row): least id of an equal window here, and whether the window
    may go on beyond the first or the last suffix. -1: no such window.

    Window w of a suffix starts w bytes into its context; a row's suffix starts ``back`` bytes into it.
    """
    n = len(starts)
    right = _padded(data, starts + back, size - back, RIGHT)
    left = _padded(data, starts + back, back, LEFT, back=True)
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(1), differ.argmax(1), RIGHT) if n > 1 else np.zeros(0, np.int64)
    found = np.full((n, SPAN), -1, np.int64)
    edge = np.zeros((n, SPAN), bool)
    for before in range(SPAN):  # bytes of the window before its anchor
        run = np.concatenate(([0], np.cumsum(common < WINDOW - before)))
        rows = np.flatnonzero((before <= back) & (back - before <= size - WINDOW))
        if not len(rows):
            continue
        own = run[rows]
        column = back[rows] - before
        edge[rows, column] = (own == run[0]) | (own == run[-1])
        found[rows, column] = least[rows]
        several = np.concatenate(([False], own[1:] == own[:-1]))
        several[:-1] |= several[1:]
        rows, own, column = rows[several], own[several], column[several]
        if not len(rows):
            continue
        part = left[rows].copy()
        part[:, before:] = 0
        words = part.view(">u8").astype(np.uint64)
        used = (before + 7) // 8
        order = np.lexsort([*(words[:, k] for k in range(used - 1, -1, -1)), own])
        w, o = words[order, :used], own[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1]).any(1)))
        low = np.minimum.reduceat(least[rows[order]], np.flatnonzero(new))
        found[rows[order], column[order]] = low[np.cumsum(new) - 1]
    return found, edge


WEIGHTS = np.random.default_rng(1).integers(0, 1 << 63, (2, WINDOW), np.uint64) * np.uint64(2) + np.uint64(1)


def _window_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the windows that start at ``at``."""
    out = np.zeros((2, len(at)), np.uint64)
    for lo in range(0, len(at), 1 << 16):
        raw = data[at[lo : lo + (1 << 16), None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)
        for k in range(2):
            x = raw * WEIGHTS[k]
            x ^= x >> np.uint64(29)
            x = (x * np.uint64(BASE)).sum(1, dtype=np.uint64)
            out[k, lo : lo + (1 << 16)] = x ^ (x >> np.uint64(32))
    return out[0], out[1]


JUDGED = "part int, row int, context binary, back int, most long, ids array<long>, bucket int, edges binary"


def _sorted(buckets: int):
    """Suffixes (context, back, least, most) of one partition to ids by window, and packed windows at its edges.

    Rows of the first kind have a null ``bucket``, those of the second kind nothing else but ``part`` and ``edges``:
    words (hash, hash, least id, row * 32 + window). Suffixes that give nobody a smaller id here and reach no edge stay
    out.
    """
    kinds = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("context", pa.binary()), ("back", pa.int32()), ("most", pa.int64()), ("ids", pa.list_(pa.int64())), ("bucket", pa.int32()), ("edges", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held).combine_chunks()
        context = table.column(0).chunk(0)
        data, bounds = _bytes(context)
        back, least, most = (table.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
        starts, size = bounds[:-1], np.diff(bounds)
        order = multikey_quicksort(_padded(data, starts + back, size - back, RIGHT).view(">u8").astype(np.uint64))
        starts, size, back, least, most = (x[order] for x in (starts, size, back, least, most))
        found, edge = least_ids(data, starts, back, size, least)
        windows = size - WINDOW + 1
        has = np.arange(SPAN) < windows[:, None]
        edge &= has
        use = np.flatnonzero(((found < most[:, None]) & has).any(1) | edge.any(1))
        for lo in range(0, len(use), 1 << 14):
            u = use[lo : lo + (1 << 14)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(windows[u]))).astype(np.int32))
            none = pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())
            cols = [pa.array(np.full(len(u), part, np.int32)), pa.array(u.astype(np.int32)), context.take(pa.array(order[u])), pa.array(back[u].astype(np.int32)), pa.array(most[u]), pa.ListArray.from_arrays(offsets, pa.array(found[u][has[u]])), *none]
            yield pa.RecordBatch.from_arrays(cols, schema=kinds)
        row, w = np.nonzero(edge)
        h1, h2 = _window_hashes(data, starts[row] + w)
        words = np.stack([h1, h2, found[row, w].view(np.uint64), (row * 32 + w).view(np.uint64)], 1)
        bucket = (h1 % np.uint64(buckets)).astype(np.int32)
        for k in np.unique(bucket).tolist():
            yield pa.RecordBatch.from_pylist([{"part": part, "bucket": k, "edges": words[bucket == k].tobytes()}], kinds)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed edge windows (part, bucket, edges) of whole buckets to (part, row, w, least) where another part has less."""
    parts, words = [], []
    for batch in batches:
        for part, edges in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words.append(np.frombuffer(edges, np.uint64).reshape(-1, 4))
            parts.append(np.full(len(words[-1]), part, np.int32))
    if not words:
        return
    part, word = np.concatenate(parts), np.concatenate(words)
    order = np.lexsort((word[:, 1], word[:, 0]))
    part, word = part[order], word[order]
    new = np.concatenate(([True], (word[1:, :2] != word[:-1, :2]).any(1)))
    own, ref = word[:, 2].view(np.int64), word[:, 3].astype(np.int64)
    least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    better = least < own
    cols = [part[better], (ref[better] // 32).astype(np.int32), (ref[better] % 32).astype(np.int32), least[better]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "row", "w", "least"])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, places, ids) to (id, h, start, end): stretches covered by windows that a smaller id has too."""
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        count = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = lists.flatten().to_numpy() < own[row]
        row, start = row[hit], place[hit]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else np.zeros(0, bool)
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(row)]))[: len(lo)] - 1
        row, start, end = row[lo], start[lo], start[hi] + WINDOW
        places = batch.column(2)
        begin = np.concatenate(([0], np.cumsum(places.value_lengths().to_numpy())))
        at = places.flatten().to_numpy()
        for some in range(0, len(row), 1 << 12):  # each stretch at each place of its row, places in order
            r, a, b = (x[some : some + (1 << 12)] for x in (row, start, end))
            n = np.diff(begin)[r]
            of = np.repeat(np.arange(len(r)), n)
            place = at[np.repeat(begin[r] - np.cumsum(n) + n, n) + np.arange(len(of))]
            a, b = place + a[of], place + b[of]
            lead = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (a[1:] > b[:-1]))))
            last = np.concatenate((lead[1:], [len(of)])) - 1
            rows = r[of[lead]]
            yield pa.RecordBatch.from_arrays([pa.array(own[rows]), batch.column(1).take(pa.array(rows)), pa.array(a[lead]), pa.array(b[last])], ["id", "h", "start", "end"])


def _key(context: str = "context") -> dict[str, Column]:
    """128 bits that stand for a context in joins."""
    return {"k1": F.xxhash64(context), "k2": F.xxhash64(F.lit("suffix"), context)}


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): the intervals (start, end) in bytes to remove from each document that has some, unmerged.

    ``h`` tells texts of one id apart: their :func:`text_hash`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), text.alias("text"))
    rows = rows.filter(F.octet_length("text") >= WINDOW)
    sizes = rows.select("id", "h", F.xxhash64(F.lit("text"), "text").alias("h2"), F.octet_length("text").cast("long").alias("n"))
    sizes = written(sizes, "suffix-sizes")
    texts = written(sizes.groupBy("h", "h2").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "suffix-texts")
    several = texts.filter("last > lead").select("h", "h2", "lead")
    copies = sizes.join(several, ["h", "h2"]).filter("id > lead").select("id", "h", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    copies = written(copies.distinct(), "suffix-copies")
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0
    parts = max(session, -(-total // PART_BYTES))
    buckets = 4 * parts
    hashes = rows.select("h", "text").mapInArrow(_hashes(buckets), HASHES).repartition(parts, "bucket")
    shared = written(hashes.mapInArrow(_shared(buckets), "bucket int, docs binary, counts binary, hashes binary"), "suffix-shared")
    lists = shared.repartition(parts, "bucket").mapInArrow(_by_document, "h long, hashes binary")
    lists = written(lists.join(texts.select("h", F.col("lead").alias("id")), "h"), "suffix-lists")
    for df in (shared, sizes, texts):
        dropped(df)
    found = rows.join(lists.hint("shuffle_hash"), ["id", "h"]).select("id", "text", "hashes", "h")
    contexts = found.mapInArrow(_contexts, "id long, h long, places array<long>, back int, context binary")
    contexts = written(contexts.withColumns(_key()), "suffix-contexts", 64)
    dropped(lists)
    suffixes = contexts.groupBy("context", "back").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    leading = F.substring("context", F.col("back") + 1, F.lit(WINDOW + SPAN))
    before = F.reverse(F.hex(F.substring("context", F.lit(1), F.col("back"))))
    ranged = suffixes.repartitionByRange(max(session, -(-contexts.count() // PART_SUFFIXES)), leading, before)
    judged = written(ranged.mapInArrow(_sorted(buckets), JUDGED).withColumns(_key()).drop("context"), "suffix-windows", 1 << 14)
    edges = judged.filter(F.col("bucket").isNotNull()).select("part", "bucket", "edges")
    better = edges.repartition(parts, "bucket").mapInArrow(_across, "part int, row int, w int, least long")
    patch = better.groupBy("part", "row").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("patch"))
    ids = F.transform("ids", lambda x, k: F.coalesce(F.element_at("patch", k), x))
    own = judged.filter(F.col("bucket").isNull()).join(written(patch, "suffix-patch"), ["part", "row"], "left")
    own = own.select("k1", "k2", "back", "most", F.when(F.col("patch").isNull(), F.col("ids")).otherwise(ids).alias("ids"))
    own = written(own.filter(F.exists("ids", lambda x: x < F.col("most"))).drop("most"), "suffix-ids")
    with_ids = contexts.select("k1", "k2", "back", "id", "h", "places").join(own, ["k1", "k2", "back"]).select("id", "h", "places", "ids")
    spans = written(with_ids.mapInArrow(_intervals, "id long, h long, start long, end long"), "suffix-spans", 1 << 13)
    for df in (contexts, judged, own):
        dropped(df)
    return spans.union(copies).groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal intervals of a union of intervals."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


RESULTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def _cut_out(text_at: int, names: list[str], text_too: bool):
    """Rows (kept columns, text, spans) to the kept columns and the results, named ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, n, digest, texts = [], [], [], [], []
            for text, spans in zip(*(batch.column(k).to_pylist() for k in (text_at, text_at + 1)), strict=True):
                raw, at, kept, runs = (text or "").encode(), 0, [], merged(spans)
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                size.append(len(raw))
                removed.append(len(raw) - len(left))
                n.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
                if text_too:
                    texts.append(text if not runs else left.decode("utf-8", "ignore"))
            made = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string())]
            made += [pa.array(texts, pa.string())] if text_too else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *made], names)

    return run


def deduplicated(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", text_too: bool = False, prefix: str = "") -> DataFrame:
    """Columns ``keep`` and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``text_too`` ``kept_text``.

    The names of the results begin with ``prefix``; kept columns of these names give way to them.
    """
    results = [T.StructField(prefix + f.name, f.dataType) for f in RESULTS.fields[: 5 if text_too else 4]]
    keep = [c for c in (keep or [id_col]) if c not in {f.name for f in results}]
    spans = removals(docs, id_col, text_col).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    rows = docs.select(*keep, F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("__id"), text_hash(text_col).alias("__h"))
    joined = rows.join(spans.hint("shuffle_hash"), ["__id", "__h"], "left").select(*keep, "__text", "__spans")
    schema = T.StructType([*joined.schema.fields[:-2], *results])
    return written(joined.mapInArrow(_cut_out(len(keep), schema.names, text_too), schema), "suffix-kept")
