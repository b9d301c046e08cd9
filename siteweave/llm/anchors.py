"""Substring dedup by difference-cover anchors: repeated windows of words are removed.

Positions modulo ``PERIOD`` = 13 that lie in the cover {0, 1, 3, 9} are anchors:
every difference modulo 13 is a difference of two cover positions, so two equal
windows of 20 words, wherever they start, have an anchor at the same place
among their first 13 words.  Only the 8 words at each anchor are hashed and
compared across the corpus.  Anchors that recur are extended: the windows
around them get a 96-bit hash of all their words, and all but the first
occurrence of each hash are removed.

Defined cases: a null or empty text has no words; documents of fewer words than
a window lose nothing; of equal ids the smaller hash of the text comes first;
repeated rows (same id, same text) are one document; a null id comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteweave.llm import repeats, scan
from siteweave.llm.store import buckets

WINDOW = 20
# fixed values: a perfect difference cover
PERIOD, COVER = 13, (0, 1, 3, 9)


def word_anchors(size: int):
    """Hash and document of the words at every anchor; a second result has the anchor's word."""
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def found(data: np.ndarray, offsets: np.ndarray, full: bool = False):
        start, end, doc = scan.words(data, offsets, ~scan.SPACE)
        hashes = scan.A.span(scan.A.prefix(data), start, end) if len(start) else np.zeros(0, np.uint64)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        word, h = scan.windows(hashes, doc, size)
        at = in_cover[(word - first[doc[word]]) % PERIOD]
        word, h = word[at], h[at]
        return (h, doc[word], word, start, end, doc, first, hashes) if full else (h, doc[word])

    return found


def removed(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of window starts that begin earlier elsewhere; all texts; the first document of each text."""
    size = window - PERIOD + 1
    if size < 1:
        raise ValueError(f"a window has at least {PERIOD} words")
    n = buckets(docs)
    anchors = word_anchors(size)
    lists, _ = repeats.recurrent(docs, anchors)
    own, first_of = repeats.texts(docs)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = repeats.Windows(n)
        for rows, data, offsets in scan.slices(batches, "text"):
            h, doc_of, word, start, end, doc, first, hashes = anchors(data, offsets, True)
            word = word[repeats.chosen(rows, h, doc_of)]
            near = scan.covered(len(start), np.maximum(word - PERIOD + 1, first[doc[word]]), np.minimum(PERIOD, word - first[doc[word]] + 1))
            at, a = scan.windows(hashes, doc, window)
            use = near[at]
            at, a = at[use], a[use]
            other = scan.B.prefix(scan.B.span(scan.B.prefix(data), start, end)) if len(start) else None
            if len(at):
                order, tkey = (rows.column(i).to_numpy() for i in (0, 1))
                windows.add(a, scan.B.span(other, at, at + window), order[doc[at]], tkey[doc[at]], at - first[doc[at]])
            if windows.full():
                yield repeats.blob_batch(windows.rows())
        yield repeats.blob_batch(windows.rows())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, known = [], []
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (known if kind == repeats.KNOWN else blobs).append(repeats.unpack(blob))
        order, tkey, start, end = (np.concatenate(x) for x in zip(repeats.windows_removed(blobs), *known))
        yield repeats.blob_batch(repeats.removed_rows(order, tkey, start, end - start, n))

    held = repeats.candidates(docs, first_of, lists)
    found = held.mapInArrow(extend, repeats.BLOBS).repartition(n, "bucket").mapInArrow(judge, repeats.BLOBS)
    return repeats.gathered(found), own, first_of


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``id``, ``n_words``, ``n_removed`` and the ``kept`` words joined by one space."""
    rows = repeats.documents(docs, id_col, text_col)
    gone, own, first_of = removed(rows, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in scan.slices(batches, "text"):
            start, end, doc = scan.words(data, offsets, ~scan.SPACE)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            count = np.diff(first)
            owner, b, e, copy = repeats.run_arrays(part)
            drop = scan.covered(len(start), first[owner] + b, e - b + window - 1)
            drop |= (copy & (count >= window))[doc] if len(doc) else False
            total = np.concatenate([[0], np.cumsum(drop)])
            n_removed = total[first[1:]] - total[first[:-1]]
            # kept words with one space after each
            member = np.zeros(len(data) + 1, np.int32)
            np.add.at(member, start[~drop], 1)
            np.add.at(member, end[~drop], -1)
            mask = np.cumsum(member[:-1]) > 0
            # the byte after a word is white space, unless the text ends there
            mask[end[~drop & (end < offsets[doc + 1])]] = True
            spaced = np.where(scan.SPACE[data], 32, data).astype(np.uint8)
            kept = []
            for i in range(part.num_rows):
                lo, hi = offsets[i], offsets[i + 1]
                kept.append(spaced[lo:hi][mask[lo:hi]].tobytes().rstrip(b" ") if n_removed[i] < count[i] else b"")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "n_removed", "kept"])

    joined = repeats.with_removed(rows, own, first_of, gone)
    kind = dict(docs.dtypes)[id_col]
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
