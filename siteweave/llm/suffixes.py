"""Suffix-array dedup with a logarithmic index family: repeated byte strings are removed.

Every window of ``LENGTH`` bytes belongs to its smallest ``GRAM``-byte hash, its
anchor; equal windows have equal anchors, so a sparse set of positions (about
one in 35) stands for all.  Windows in a row with one anchor make a segment.
Anchors that occur once in the corpus are screened out, and the segments of the
others meet by anchor.

There they are taken in batches in document order.  A batch's windows are the
suffixes that start in its segments, cut off at ``LENGTH`` bytes, the longest
match asked for; sorted, they are the batch's suffix array.  It is merge-scanned
against the levels of the index for matches, what is new becomes a level, and
levels of equal rank are merged, so that there are about log n of them.

Equal segments are reduced to the first before they are sent and before they
are indexed.  An anchor with more than ``heavy`` occurrences has its windows
dealt out by their own hash instead, first occurrence by first occurrence,
which is exact as well.

Defined cases: a null text is empty; shorter texts than ``LENGTH`` lose nothing;
of equal ids the smaller hash of the text comes first; repeated rows (same id,
same text) are one document; a null id comes last.  Removed bytes may split a
character: the kept text is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteweave.llm import repeats, scan
from siteweave.llm.store import buckets

LENGTH, GRAM = 100, 32
#: windows of a batch whose suffix array is built at once; windows that share a family of levels, if of several anchors
BATCH, FAMILY = 1 << 16, 1 << 19
SEGMENTS = 3  # kind of packed row, beside those of `repeats`


class SuffixIndex:
    """A family of sorted suffix arrays whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Mask of the windows that are in the index or earlier in the batch; the others join it."""
        order = np.argsort(windows, kind="stable")
        array = windows[order]
        seen = np.concatenate([[False], array[1:] == array[:-1]])
        for _, level in self.levels:
            at = np.searchsorted(level, array)
            seen |= level[np.minimum(at, len(level) - 1)] == array
        new, rank = array[~seen], 0
        if len(new):
            while self.levels and self.levels[-1][0] == rank:
                new = np.sort(np.concatenate([self.levels.pop()[1], new]), kind="stable")  # two runs: a merge
                rank += 1
            self.levels.append((rank, new))
        out = np.zeros(len(windows), bool)
        out[order] = seen
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span:])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, first window, number of windows and anchor position of each segment."""
    if len(data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    prefix = scan.A.prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = scan.A.span(prefix, at, at + gram)
    low = sliding_min(h >> scan.U(32) << scan.U(32) | at.astype(np.uint64), length - gram + 1)
    anchor = (low & scan.U(0xFFFFFFFF)).astype(np.int64)  # of the window that starts there; the leftmost of equals
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    docs = np.repeat(np.arange(len(size)), size)
    first_window = np.concatenate([[0], np.cumsum(size)])
    start = offsets[docs] + np.arange(first_window[-1]) - first_window[docs]
    anchor = anchor[start]
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])])) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(start)))
    return h[anchor[edge]], docs[edge], start[edge], count, anchor[edge]


def byte_anchors(length: int, gram: int):
    def found(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, doc, *_ = segments(data, offsets, length, gram)
        return h, doc

    return found


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of many runs, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _run_hashes(data: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each of many runs that follow each other, some runs at a time."""
    ends, out, k = np.cumsum(size), [np.empty(len(size), np.uint64) for _ in range(2)], 0
    while k < len(size):
        low = ends[k] - size[k]
        stop = max(k + 1, int(np.searchsorted(ends, low + repeats.GATHER, "right")))
        own = ends[k:stop] - low
        for hashes, poly in zip(out, (scan.A, scan.B)):
            hashes[k:stop] = poly.span(poly.prefix(data[low: ends[stop - 1]]), own - size[k:stop], own)
        k = stop
    return out


class Segments:
    """Segments of a task; equal ones are reduced to the first before they are sent."""

    def __init__(self, n: int, length: int) -> None:
        self.n, self.length, self.held, self.size = n, length, [], 0

    def add(self, h, order, tkey, start, count, left, data) -> None:
        self.held.append((h, order, tkey, start.astype(np.int32), count.astype(np.int32), left.astype(np.int32), data))
        self.size += len(data)

    def rows(self) -> list[tuple[int, int, bytes]]:
        if not self.size:
            return []
        h, order, tkey, start, count, left, data = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        first, later = equal_segments(h, order, tkey, start, count, left, data, self.length)
        size = count + self.length - 1
        begin = np.cumsum(size) - size
        bucket = (h % scan.U(self.n)).astype(np.int64)
        first = first[np.lexsort((start[first], tkey[first], order[first], bucket[first]))]
        rows = []
        edges = np.flatnonzero(np.diff(bucket[first], prepend=-1))
        for s, e in zip(edges, [*edges[1:], len(first)]):
            at = first[s:e]
            rows.append((int(bucket[at[0]]), SEGMENTS, repeats.pack(*[c[at] for c in (h, order, tkey, start, count, left)], _gather(data, begin[at], size[at]))))
        return rows + repeats.removed_rows(order[later], tkey[later], start[later], count[later], self.n)


def equal_segments(h, order, tkey, start, count, left, data, length) -> tuple[np.ndarray, np.ndarray]:
    """First of each set of equal segments, and those that come later, by document order."""
    a, b = _run_hashes(data, count + length - 1)
    by = np.lexsort((start, tkey, order, left, count, b, a))
    same = np.concatenate([[False], *[(a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1]) & (count[by][1:] == count[by][:-1]) & (left[by][1:] == left[by][:-1])]])
    lead = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    itself = (order[lead] == order[by]) & (tkey[lead] == tkey[by]) & (start[lead] == start[by])
    return by[~same], by[same & ~itself]


def _matches(use, order, tkey, start, count, begin, suffix, length) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of the windows of some segments, in document order, through one family of levels."""
    index, ends, k = SuffixIndex(), np.cumsum(count[use]), 0
    while k < len(use):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH)))
        n = count[use[k:stop]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(use[k:stop], n)
        seen = index.add(np.ascontiguousarray(suffix[begin[own] + inner]).view(f"S{length}").reshape(-1))
        at = start[own[seen]] + inner[seen]
        yield order[own[seen]], tkey[own[seen]], at, at + 1
        k = stop


def indexed(h, order, tkey, start, count, left, data, length: int) -> tuple[np.ndarray, ...]:
    """``(ord, tkey, start, end)`` of the windows in the segments of a bucket that start earlier elsewhere."""
    first, later = equal_segments(h, order, tkey, start, count, left, data, length)
    parts = [(order[later], tkey[later], start[later], start[later] + count[later])]
    # an anchor with one segment left has no match; repeats inside a segment would be an anchor of another
    first = first[np.argsort(h[first], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], h[first][1:] != h[first][:-1]]))
    several = np.repeat(np.diff(np.append(edge, len(first))) > 1, np.diff(np.append(edge, len(first))))
    use = first[several]
    begin = np.cumsum(count + length - 1) - (count + length - 1)
    suffix = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data
    # windows match within their anchor only: some anchors at a time share a family of levels
    ends = np.cumsum(count[use])
    last = np.flatnonzero(np.concatenate([h[use][1:] != h[use][:-1], [True]])) + 1 if len(use) else []
    at = 0
    for stop in last:
        if stop == len(use) or ends[stop - 1] - (ends[at - 1] if at else 0) >= FAMILY:
            some = use[at:stop]
            parts += _matches(some[np.lexsort((start[some], tkey[some], order[some]))], order, tkey, start, count, begin, suffix, length)
            at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = repeats.HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of window starts that begin earlier elsewhere; all texts; the first document of each text."""
    n = buckets(docs)
    lists, heavies = repeats.recurrent(docs, byte_anchors(length, gram), heavy)
    own, first_of = repeats.texts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = Segments(n, length), repeats.Windows(n)
        for rows, data, offsets in scan.slices(batches, "text"):
            h, doc, start, count, anchor = segments(data, offsets, length, gram)
            use = repeats.chosen(rows, h, doc)
            h, doc, start, count, anchor = (x[use] for x in (h, doc, start, count, anchor))
            order, tkey = (rows.column(i).to_numpy() for i in (0, 1))
            hot = np.isin(h, heavies)
            some = ~hot
            if some.any():
                d, s, c = doc[some], start[some], count[some]
                held.add(h[some], order[d], tkey[d], s - offsets[d], c, anchor[some] - s, _gather(data, s, c + length - 1))
            if hot.any():
                d, s, c = doc[hot], start[hot], count[hot]
                at = _gather(np.arange(len(data)), s, c)
                d = np.repeat(d, c)
                a, b = (p.span(p.prefix(data), at, at + length) for p in (scan.A, scan.B))
                windows.add(a, b, order[d], tkey[d], at - offsets[d])
            if held.size > 8 * repeats.GATHER:
                yield repeats.blob_batch(held.rows())
            if windows.full():
                yield repeats.blob_batch(windows.rows())
        yield repeats.blob_batch(held.rows() + windows.rows())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {repeats.SINGLE: [], repeats.KNOWN: [], SEGMENTS: []}
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts[kind].append(repeats.unpack(blob))
        out = [repeats.windows_removed(parts[repeats.SINGLE]), *parts[repeats.KNOWN]]
        if parts[SEGMENTS]:
            out.append(indexed(*(np.concatenate(x) for x in zip(*parts[SEGMENTS])), length))
        order, tkey, start, end = (np.concatenate(x) for x in zip(*out))
        yield repeats.blob_batch(repeats.removed_rows(order, tkey, start, end - start, n))

    held = repeats.candidates(docs, first_of, lists)
    found = held.mapInArrow(cut, repeats.BLOBS).repartition(n, "bucket").mapInArrow(judge, repeats.BLOBS)
    return repeats.gathered(found), own, first_of


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          heavy: int = repeats.HEAVY) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes) and the ``kept`` bytes."""
    rows = repeats.documents(docs, id_col, text_col)
    gone, own, first_of = removed(rows, length, gram, heavy)
    kind = dict(docs.dtypes)[id_col]
    span = pa.struct([("b", pa.int64()), ("e", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in scan.slices(batches, "text"):
            owner, b, e, copy = repeats.run_arrays(part)
            size = np.diff(offsets)
            drop = scan.covered(len(data), offsets[owner] + b, e - b + length - 1)
            drop |= np.repeat(copy & (size >= length), size)
            total = np.concatenate([[0], np.cumsum(drop)])
            spans, kept = [], []
            for i in range(part.num_rows):
                lo, hi = offsets[i], offsets[i + 1]
                own_spans = scan.runs(drop[lo:hi]) if total[hi] > total[lo] else ((), ())
                spans.append([{"b": int(x), "e": int(y)} for x, y in zip(*own_spans)])
                kept.append(data[lo:hi][~drop[lo:hi]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()),
                 pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "spans", "kept"])

    joined = repeats.with_removed(rows, own, first_of, gone)
    return joined.mapInArrow(keep, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, spans array<struct<b:bigint,e:bigint>>, kept binary")
