"""Benchmark decontamination: windows of test items looked up in whole training texts.

The hash set of the test windows is sent to every task.  Its size is checked:
a benchmark over ``block_bytes`` is taken in blocks, one pass over the
documents each, so no task ever holds more than one block.  Hits of the hash
set are verified word by word.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window; an item of fewer than ``n`` words is one window; repeated
rows are judged alike; items that repeat an id count once; a null item id is
the empty string.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import store

N = 13
#: text bytes of the benchmark that one task holds at most as a hash set
BLOCK_BYTES = 32 << 20
HITS = "key bigint, fp bigint, n_words bigint, spans array<struct<b:int,e:int>>, items array<string>"


class WindowSet:
    """Windows of a block of items by length: sorted hashes, the words, the items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for item, text in items:
            data = scan.lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
            start, end, doc = scan.words(data, np.array([0, len(data)]), scan.ALNUM)
            if not len(start):
                continue
            size = min(n, len(start))
            raw = data.tobytes()
            tokens = [raw[s:e] for s, e in zip(start, end)]
            first, hashes = scan.windows(scan.A.span(scan.A.prefix(data), start, end), doc, size)
            by_hash = found.setdefault(size, {})
            for i, h in zip(first.tolist(), hashes.tolist()):
                by_hash.setdefault(h, {}).setdefault(b" ".join(tokens[i: i + size]), set()).add(item)
        self.by_size = []
        for size, by_hash in sorted(found.items()):
            sieve = np.zeros(1 << 20, bool)
            hashes = np.array(list(by_hash), np.uint64)
            sieve[hashes & scan.U((1 << 20) - 1)] = True
            self.by_size.append((size, sieve, by_hash))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Word bounds per document, mask of hit words, items per document."""
        start, end, doc = scan.words(data, offsets, scan.ALNUM)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        hit = np.zeros(len(start), bool)
        if not len(start):
            return bounds, hit, items
        hashes = scan.A.span(scan.A.prefix(data), start, end)
        for size, sieve, by_hash in self.by_size:
            first, found = scan.windows(hashes, doc, size)
            maybe = sieve[found & scan.U((1 << 20) - 1)]
            for i, h in zip(first[maybe].tolist(), found[maybe].tolist()):
                if texts := by_hash.get(h):
                    said = b" ".join(data[start[j]: end[j]].tobytes() for j in range(i, i + size))
                    if ids := texts.get(said):
                        hit[i: i + size] = True
                        items[doc[i]] |= ids
        return bounds, hit, items


def _scan(docs: DataFrame, block: list[tuple[str, str | None]], n: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(block, n)
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("n_words", pa.int64()),
                            ("spans", pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])
        for rows, data, offsets in scan.slices(batches, "text"):
            bounds, hit, items = known.hits(scan.lower_ascii(data), offsets)
            spans = []
            for i, own in enumerate(items):
                b, e = scan.runs(hit[bounds[i]: bounds[i + 1]]) if own else ((), ())
                spans.append([{"b": int(x), "e": int(y)} for x, y in zip(b, e)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, schema.field("spans").type),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)

    return docs.mapInArrow(task, HITS)


def scan_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id``, ``n_words``, hit word runs ``spans[b, e)`` and the ``items`` that occur."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _scan(rows, [tuple(r) for r in items.collect()], n).drop("fp").withColumnRenamed("key", id_col)
    parts = []
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]
        parts.append(store(_scan(rows, own, n), f"hits{k}"))
    # the text's hash joins the key, so that a repeated id with another text stays apart
    merged = reduce(DataFrame.unionByName, parts).groupBy("key", "fp", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"))
    copies = F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int")))
    return merged.select(F.col("key").alias(id_col), "n_words", _union(F.col("spans")).alias("spans"), "items", copies.alias("copy")).drop("copy")


def _union(spans):
    """Merge sorted runs that touch."""
    empty = F.array().cast("array<struct<b:int,e:int>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["b"].alias("b"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["e"] >= x["b"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, step)


def judged(hits: DataFrame, part: int = 20) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``: at least one in ``part`` words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["e"] - x["b"]))
    return (hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words"))))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", n: int = N, part: int = 20,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that are not contaminated, with all their columns.

    One pass without a shuffle where the benchmark is one block.  A larger one
    goes through :func:`scan_hits`, and the contaminated documents leave by an
    anti join on id and text.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > block_bytes:
        bad = judged(scan_hits(docs.withColumn(id_col, F.xxhash64(id_col, "text")), benchmark, id_col, n=n, block_bytes=block_bytes), part)
        bad = bad.where("contaminated").select(F.col(id_col).alias("__bad")).distinct()
        return docs.join(bad, F.xxhash64(docs[id_col], docs["text"]) == F.col("__bad"), "left_anti")
    items = [("", r[0]) for r in benchmark.select("text").collect()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(items, n)
        for rows, data, offsets in scan.slices(batches, "text"):
            bounds, hit, _ = known.hits(scan.lower_ascii(data), offsets)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[bounds[1:]] - total[bounds[:-1]]
            yield rows.filter(pa.array(~((n_hit > 0) & (part * n_hit >= np.diff(bounds)))))

    return docs.mapInArrow(task, docs.schema)
