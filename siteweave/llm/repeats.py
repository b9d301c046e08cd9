"""What the two operators on repeated passages share: screening by anchors, earliest windows, joins with texts.

A document is a pair of id and text.  ``ord`` is its place (the id, nulls last),
``tkey`` a 64-bit hash of the text; documents are ordered by both.  Copies of a
whole text are told by its MD5: all but the first are repeats from end to end
and need no anchors of their own.

Data travel as one packed row per task and bucket, so a shuffle carries arrays.
In each task equal items are reduced to their first, as a combiner would: a
passage in a third of all documents sends one item per task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import buckets, store

LAST = (1 << 63) - 1
#: items a task gathers before it reduces and sends them
GATHER = 1 << 20
#: an anchor of more occurrences is heavy, and at most so many anchors are: a bound for what is sent to all tasks
HEAVY, HEAVY_MOST = 5000, 1 << 20

Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def blob_rows(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Deal sorted columns out by bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for s, e in zip(edges, [*edges[1:], len(order)]):
        at = order[s:e]
        yield int(bucket[at[0]]), kind, pack(*[c[at] for c in columns])


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "kind", "blob"])


BLOBS = "bucket int, kind int, blob binary"
SINGLE, SEVERAL, KNOWN = 0, 1, 2


def recurrent(docs: DataFrame, anchors: Anchors, heavy: int = HEAVY) -> tuple[DataFrame, np.ndarray]:
    """Anchors found more than once, as ``(tkey, hs)``; and the heavy anchors, a bounded sorted array.

    ``hs`` has 32 bits of each recurrent anchor of that text.  A false match of
    those bits only makes a candidate more.
    """
    n = buckets(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, t = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(edges, len(h)))
            one = edges[count == 1]
            many = edges[count > 1]
            later = np.ones(len(h), bool)
            later[edges] = False
            bucket = (h % scan.U(n)).astype(np.int64)
            rows = list(blob_rows(bucket[one], [h[one], t[one]], SINGLE))
            rows += blob_rows(bucket[many], [h[many], t[many], count[count > 1].astype(np.int32)], SEVERAL)
            # the first of several is sent for the others of its hash; these know already, and are spread by text
            rows += blob_rows((t[later].view(np.uint64) % scan.U(n)).astype(np.int64), [h[later], t[later]], KNOWN)
            return blob_batch(rows)

        done: set[int] = set()
        for rows, data, offsets in scan.slices(batches, "text"):
            tkeys = rows.column(0).to_numpy(zero_copy_only=False)
            h, doc = anchors(data, offsets)
            fresh = np.array([k not in done and not done.add(k) for k in tkeys.tolist()], bool)
            if len(done) > GATHER:
                done.clear()
            use = fresh[doc]
            if use.any():  # short texts and copies have no anchors to send
                held.append((h[use], tkeys[doc[use]]))
            if sum(len(x) for x, _ in held) > GATHER:
                yield out()
        if held:
            yield out()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {SINGLE: [], SEVERAL: [], KNOWN: []}
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts[kind].append(unpack(blob))
        h = np.concatenate([p[0] for k in (SINGLE, SEVERAL) for p in parts[k]] or [np.zeros(0, np.uint64)])
        t = np.concatenate([p[1] for k in (SINGLE, SEVERAL) for p in parts[k]] or [np.zeros(0, np.int64)])
        count = np.concatenate([np.ones(len(p[0]), np.int64) if k == SINGLE else p[2].astype(np.int64) for k in (SINGLE, SEVERAL) for p in parts[k]] or [np.zeros(0, np.int64)])
        order = np.lexsort((t, h))
        h, t, count = h[order], t[order], count[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(h))[: len(edges)]
        total = np.add.reduceat(count, edges) if len(edges) else count
        again = (t[edges] != t[ends - 1]) | (total > ends - edges)
        mask = np.repeat(again, ends - edges)
        hs = np.concatenate([h[mask], *[p[0] for p in parts[KNOWN]]])
        ts = np.concatenate([t[mask], *[p[1] for p in parts[KNOWN]]])
        many = total >= heavy
        # by text: one packed row per bucket of texts
        order = np.argsort(ts, kind="stable")
        hs, ts = (hs[order] >> scan.U(32)).astype(np.uint32), ts[order]
        rows = list(blob_rows((ts.view(np.uint64) % scan.U(n)).astype(np.int64), [ts, hs], KNOWN)) if len(ts) else []
        batch = blob_batch(rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)
        if many.any():
            none = [pa.nulls(many.sum(), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(h[edges][many].view(np.int64)), pa.array(total[many])], names)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob) for b in batches for blob in b.column(2).to_pylist()]
        if not parts:
            return
        ts, hs = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ts, kind="stable")
        ts, hs = ts[order], hs[order].view(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]]))
        for k in range(0, len(starts), 1 << 14):
            some = starts[k: k + (1 << 14)]
            end = starts[k + len(some)] if k + len(some) < len(starts) else len(ts)
            bounds = np.append(some, end) - some[0]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hs[some[0]: end]))
            yield pa.RecordBatch.from_arrays([pa.array(ts[some]), lists], ["tkey", "hs"])

    names = ["bucket", "kind", "blob", "heavy", "n"]
    sent = docs.select("tkey", "text").mapInArrow(send, BLOBS).repartition(n, "bucket")
    found = store(sent.mapInArrow(judge, f"{BLOBS}, heavy bigint, n bigint"), "anchors")
    top = found.where("heavy is not null").orderBy(F.desc("n"), "heavy").limit(HEAVY_MOST).select("heavy").collect()
    heavies = np.sort(np.array([r.heavy for r in top], np.int64).view(np.uint64))
    packed = found.where("heavy is null").select("bucket", "kind", "blob").repartition(n, "bucket")
    return packed.mapInArrow(by_text, "tkey bigint, hs array<int>"), heavies


def texts(docs: DataFrame) -> DataFrame:
    """``(ord, tkey, md5, first)``: every document and the first one of its text."""
    own = store(docs.select("ord", "tkey", F.md5("text").alias("md5")), "texts")
    first = own.groupBy("tkey", "md5").agg(F.min("ord").alias("first"))
    return own, first


def candidates(docs: DataFrame, first: DataFrame, lists: DataFrame) -> DataFrame:
    """``(ord, tkey, text, hs)`` of the first document of every text that has recurrent anchors."""
    marks = first.join(lists, "tkey")
    rows = docs.select("ord", "tkey", "text", F.md5("text").alias("md5"))
    return rows.join(marks, ["tkey", "md5"]).where("ord = first").select("ord", "tkey", "text", "hs")


def chosen(rows: pa.RecordBatch, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the anchors that are listed for their document in column ``hs``."""
    hs = rows.column(3)
    own = np.repeat(np.arange(len(hs)), np.diff(np.asarray(hs.offsets)))
    listed = np.unique(own.astype(np.uint64) << scan.U(32) | np.asarray(hs.flatten()).view(np.uint32).astype(np.uint64))
    key = doc.astype(np.uint64) << scan.U(32) | h >> scan.U(32)
    if not len(listed):
        return np.zeros(len(h), bool)
    return listed[np.minimum(np.searchsorted(listed, key), len(listed) - 1)] == key


class Windows:
    """Windows of a task by a 96-bit hash; equal ones are reduced to the first before they are sent."""

    def __init__(self, n: int) -> None:
        self.n, self.held, self.size = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, tkey: np.ndarray, place: np.ndarray) -> None:
        self.held.append((a, (b >> scan.U(32)).astype(np.uint32), order, tkey, place.astype(np.int32)))
        self.size += len(a)

    def full(self) -> bool:
        return self.size > GATHER

    def rows(self) -> list[tuple[int, int, bytes]]:
        if not self.size:
            return []
        columns, later = split_later(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [], 0
        bucket = (columns[0] % scan.U(self.n)).astype(np.int64)
        first = np.flatnonzero(~later)
        order = first[np.lexsort((columns[4][first], columns[3][first], columns[2][first]))]  # by document: packs better
        rows = list(blob_rows(bucket[order], [c[order] for c in columns], SINGLE))
        return rows + removed_rows(columns[2][later], columns[3][later], columns[4][later], 1, self.n)


def split_later(a: np.ndarray, b: np.ndarray, order: np.ndarray, tkey: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sort windows by hash and order; mask those whose hash starts earlier elsewhere."""
    at = np.lexsort((place, tkey, order, b, a))
    a, b, order, tkey, place = columns = [x[at] for x in (a, b, order, tkey, place)]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    # rows that repeat a document's id and text are the same document
    return columns, (order[first] != order) | (tkey[first] != tkey) | (place[first] != place)


def removed_rows(order: np.ndarray, tkey: np.ndarray, start: np.ndarray, width: np.ndarray | int, n: int) -> list[tuple[int, int, bytes]]:
    """Windows known as repeats, spread over the buckets by text."""
    if not len(order):
        return []
    columns = [order, tkey, start.astype(np.int32), (start + width).astype(np.int32)]
    return list(blob_rows((tkey.view(np.uint64) % scan.U(n)).astype(np.int64), columns, KNOWN))


REMOVED = "ord bigint, tkey bigint, runs array<int>"


def removed_lists(order: np.ndarray, tkey: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of window starts ``[start, end)`` as one row per document, touching runs merged."""
    if not len(order):
        return
    at = np.lexsort((start, tkey, order))
    order, tkey, start, end = (x[at] for x in (order, tkey, start, end))
    same = np.concatenate([[False], (order[1:] == order[:-1]) & (tkey[1:] == tkey[:-1])])
    joined = same.copy()
    joined[1:] &= start[1:] <= end[:-1]
    begin = np.flatnonzero(~joined)
    end = np.maximum.reduceat(end, begin)
    order, tkey, start, same = order[begin], tkey[begin], start[begin], same[begin]
    docs = np.flatnonzero(~same)
    runs = np.stack([start, end], axis=1).astype(np.int32).reshape(-1)
    schema = pa.schema([("ord", pa.int64()), ("tkey", pa.int64()), ("runs", pa.list_(pa.int32()))])
    for k in range(0, len(docs), 1 << 14):
        some = docs[k: k + (1 << 14)]
        stop = docs[k + len(some)] if k + len(some) < len(docs) else len(order)
        bounds = 2 * (np.append(some, stop) - some[0])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(runs[2 * some[0]: 2 * stop]))
        yield pa.RecordBatch.from_arrays([pa.array(order[some]), pa.array(tkey[some]), lists], schema=schema)


def gathered(judged: DataFrame) -> DataFrame:
    """Packed removed windows of all buckets to one row of merged runs per document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob) for b in batches for blob in b.column(2).to_pylist()]
        if parts:
            yield from removed_lists(*(np.concatenate(x) for x in zip(*parts)))

    return judged.repartition(buckets(judged), "bucket").mapInArrow(task, REMOVED)


def windows_removed(blobs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """``(ord, tkey, start, end)`` of the windows of a bucket that start earlier elsewhere."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    (_, _, order, tkey, place), later = split_later(*(np.concatenate(x) for x in zip(*blobs)))
    return order[later], tkey[later], place[later], place[later] + 1


def with_removed(docs: DataFrame, own: DataFrame, first: DataFrame, removed: DataFrame) -> DataFrame:
    """``(id, text, runs, copy)`` of every row: its removed window starts and whether its text came before."""
    copies = own.join(first, ["tkey", "md5"]).where("ord <> first").select("ord", "tkey", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("runs"))
    every = removed.select("ord", "tkey", F.lit(False).alias("copy"), "runs").unionByName(copies)
    marks = every.groupBy("ord", "tkey").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("copy").alias("copy"))  # runs of one document
    joined = docs.join(marks, ["ord", "tkey"], "left")
    return joined.select("id", "text", F.coalesce("runs", F.array().cast("array<int>")).alias("runs"), F.coalesce("copy", F.lit(False)).alias("copy"))


def run_arrays(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the runs in column 2, and the mask of copies in column 3."""
    lists = rows.column(2)
    flat = np.asarray(lists.flatten()).reshape(-1, 2).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)) // 2)
    return doc, flat[:, 0], flat[:, 1], rows.column(3).to_numpy(zero_copy_only=False).astype(bool)
