"""A stored set of URLs handled before (LK21, ST1), asked without reading most of it.

URLs lie in folders by batch and by a hash of the URL; each batch has a Bloom filter per hash bucket.  An intake first asks the filters: a
URL that no filter knows is new, and nothing of the set is read for it.  What a filter may know is decided exactly, by an anti join that
reads only the buckets concerned.

A batch sees what batches before it have added, never itself: run again, it finds the same rows and writes the same folders, so a job or
stream may be stopped and repeated at any point.  :meth:`SeenSet.compact` merges the filters of old batches; sizes are fixed, so filters are
merged by or-ing their bits.

Null URLs are never known and never stored; of the rows of an intake that share a URL (null included) the one with the smallest page_id counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.session import materialise

URLS = "url string, batch bigint, bucket int"
FILTERS = "bucket int, bits binary, batch bigint"
#: bits a URL sets
HASHES = 7


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of the bits of each 64-bit hash, one row per URL."""
    h = hashes.astype(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (one[:, None] + np.arange(HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


@dataclass
class SeenSet:
    """``buckets`` and ``bits`` (per bucket and batch; about ten for each URL that one is to hold) are fixed when the set is begun."""

    spark: SparkSession
    path: str
    buckets: int = 256
    bits: int = 1 << 20

    def _bucketed(self, urls: DataFrame) -> DataFrame:
        h = F.xxhash64("url")
        return urls.select("url", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 17), F.lit(self.buckets)).cast("int").alias("bucket"))

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the set; empty before the first batch."""
        if not _exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def urls(self) -> DataFrame:
        return self._read("urls", URLS)

    def add(self, urls: DataFrame, batch: int) -> None:
        """Store a batch's distinct URLs and their filters; the same batch may be stored again."""
        known = self._bucketed(urls.where("url is not null").select("url").distinct())
        folder = f"{self.path}/urls/batch={batch}"
        known.repartition("bucket").select("url", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        self._write_filters(known, batch)

    def _write_filters(self, known: DataFrame, batch: int) -> None:
        bits = self.bits

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, np.zeros(bits, bool)
            for b in batches:
                buckets, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1)) if len(buckets) else []
                for s, e in zip(edges, [*edges[1:], len(buckets)]):
                    if buckets[s] != at:
                        if at is not None:
                            yield _filter_row(at, held)
                        at, held = int(buckets[s]), np.zeros(bits, bool)
                    held[bit_places(hashes[s:e], bits).reshape(-1)] = True
            if at is not None:
                yield _filter_row(at, held)

        rows = known.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "h")
        rows.mapInArrow(build, "bucket int, bits binary").write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")

    def compact(self, before: int) -> None:
        """Merge the filters of all batches below ``before`` into those of the last of them."""
        old = self._read("filters", FILTERS).where(F.col("batch") < before)
        last = old.agg(F.max("batch")).first()[0]
        if last is None:
            return

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                for bucket, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = np.frombuffer(bits, np.uint8)
                    if bucket != at:
                        if at is not None:
                            yield _packed_row(at, held)
                        at, held = bucket, own.copy()
                    else:
                        held |= own
            if at is not None:
                yield _packed_row(at, held)

        merged = old.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "bits").mapInArrow(merge, "bucket int, bits binary")
        # beside the old ones first: filters of a batch may stand twice, never nowhere
        merged.write.mode("overwrite").parquet(f"{self.path}/merged/batch={last}")
        kept = self.spark.read.parquet(f"{self.path}/merged/batch={last}")
        kept.write.mode("overwrite").parquet(f"{self.path}/filters/batch={last}")
        for r in old.where(F.col("batch") < last).select("batch").distinct().collect():
            _delete(self.spark, f"{self.path}/filters/batch={r.batch}")
        _delete(self.spark, f"{self.path}/merged")

    def maybe_known(self, urls: DataFrame, batch: int | None = None) -> DataFrame:
        """``(url, bucket)`` of the distinct URLs that a filter may know."""
        asked = self._bucketed(urls)
        filters = self._read("filters", FILTERS)
        if batch is not None:
            filters = filters.where(F.col("batch") < batch)
        none = F.lit(None)
        rows = filters.join(F.broadcast(asked.select("bucket").distinct()), "bucket", "left_semi").select(
            "bucket", F.lit(0).alias("kind"), "bits", none.cast("string").alias("url"), none.cast("bigint").alias("h")).unionByName(
            asked.select("bucket", F.lit(1).alias("kind"), none.cast("binary").alias("bits"), "url", "h"))
        bits = self.bits

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                buckets, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = np.flatnonzero((np.diff(buckets, prepend=buckets[0] - 1) != 0) | (np.diff(kinds, prepend=kinds[0]) != 0)) if len(buckets) else []
                for s, e in zip(edges, [*edges[1:], len(buckets)]):
                    if buckets[s] != at:
                        at, held = int(buckets[s]), np.zeros(bits // 8, np.uint8)
                    if kinds[s] == 0:
                        for own in b.column(2).slice(s, e - s).to_pylist():
                            held |= np.frombuffer(own, np.uint8)
                        continue
                    places = bit_places(b.column(4).slice(s, e - s).to_numpy(), bits)
                    known = (held[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
                    found = b.column(3).slice(s, e - s).filter(pa.array(known))
                    yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(found), at, np.int32))], ["url", "bucket"])

        # filters come before the URLs of their bucket: a task holds one filter
        return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(probe, "url string, bucket int")

    def known(self, urls: DataFrame, batch: int | None = None) -> DataFrame:
        """``(url)`` of the distinct URLs that are in the set: those a filter may know, told exactly from the buckets they lie in."""
        maybe = materialise(self.maybe_known(urls.where("url is not null").select("url").distinct(), batch), "maybe_known")
        hit = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # one number per bucket at most
        stored = self.stored(hit, batch)
        return materialise(maybe.join(stored.select("url", "bucket"), ["bucket", "url"], "left_semi").select("url"), "known")

    def stored(self, hit: list[int], batch: int | None = None) -> DataFrame:
        """The URLs of some buckets; no file of another bucket is read."""
        found = self.urls().where(F.col("bucket").isin(hit) if hit else F.lit(False))
        return found if batch is None else found.where(F.col("batch") < batch)

    def fresh(self, pages: DataFrame, batch: int | None = None) -> DataFrame:
        """Pages whose URL no earlier batch had, each URL once (LK21)."""
        keep = pages.select("url", "page_id").join(self.known(pages, batch), "url", "left_anti").groupBy("url").agg(F.min("page_id").alias("page_id"))
        return pages.join(keep.select("page_id"), "page_id", "left_semi")


def _filter_row(bucket: int, held: np.ndarray) -> pa.RecordBatch:
    return _packed_row(bucket, np.packbits(held, bitorder="little"))


def _packed_row(bucket: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["bucket", "bits"])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    system, p = _path(spark, path)
    system.delete(p, True)
