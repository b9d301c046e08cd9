"""SimHash near-dedup with a covering family of bit masks.

A fingerprint has a bit set if more than half of the 64-bit hashes of the
text's word shingles have it.  For radius ``r`` every bit position gets a
non-zero vector of ``r + 1`` bits, and each non-zero vector ``v`` makes a mask
of the positions whose vector has an odd product with ``v``.  For ``r``
differing positions, ``r`` equations in ``r + 1`` unknowns leave a non-zero ``v``
whose mask avoids them all: every pair within the radius collides in one of
the ``2 ** (r + 1) - 1`` tables, so nothing is lost.

Copies share a fingerprint and are one node.  Collisions are verified by bit
distance.  A bucket of more than ``BUCKET`` fingerprints is not compared pair
by pair: its fingerprints are linked through the words half the radius away,
which is exact and linear (two fingerprints are within ``r`` of each other if
and only if they share such a word, ``r`` even).

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; fewer words than a shingle are one shingle; repeated shingles count
each time; repeated rows share a fingerprint; rows with a null id keep a null
component and do not name one.  :func:`keep_one` keeps a null id only where a
component has no other.  Extra columns stay, whatever their names (but for
those that begin with two underscores).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.components import components
from siteweave.llm.store import store

SHINGLE, RADIUS, SEED = 3, 2, 42
#: fingerprints of a bucket that are compared pair by pair; more go the linear way
BUCKET = 64


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle in a slice, and the bounds of each document's shingles."""
    data = scan.lower_ascii(data)
    start, end, doc = scan.words(data, offsets, ~scan.SPACE)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    # words of a document, one space apart, follow each other in one buffer
    keep = ~scan.SPACE[data]
    keep[end[end < len(data)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(scan.SPACE[data], 32, data)[keep].astype(np.uint8).tobytes()
    first_word = np.concatenate([[0], np.cumsum(n)])
    bounds = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(n)), count)
    first = first_word[own] + np.arange(bounds[-1]) - bounds[own]
    last = np.minimum(first + size, first_word[own + 1]) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(text)
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(place[start[first]].tolist(), place[end[last] - 1].__add__(1).tolist())),
                         np.uint64, len(first))
    return hashes, bounds


def fingerprint_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One fingerprint per document; no shingles: zero."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    step = 1 << 16
    for k in range(0, len(full), 512):  # a run of documents at a time bounds the bit matrix
        some = full[k: k + 512]
        votes = np.zeros((len(some), 64), np.int64)
        lo, hi = bounds[some[0]], bounds[some[-1] + 1]
        owner = np.searchsorted(bounds[some + 1], np.arange(lo, hi), "right")
        for at in range(0, hi - lo, step):
            part = hashes[lo + at: min(lo + at + step, hi)]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = owner[at: at + len(part)]
            edges = np.flatnonzero(np.diff(own, prepend=-1))
            votes[own[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        n = (bounds[some + 1] - bounds[some])[:, None]
        out[some] = np.packbits(2 * votes > n, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, fp, tkey)`` with the fingerprint as a signed 64-bit integer and a hash of the text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in scan.slices(batches, "text"):
            found = fingerprint_bits(*shingle_hashes(data, offsets, size))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64)), rows.column(2)], ["id", "fp", "tkey"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))
    return rows.mapInArrow(task, "id bigint, fp bigint, tkey bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering family as unsigned 64-bit masks."""
    size = 2 ** (radius + 1) - 1
    vector = [i % size + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints that connect all pairs within the radius.

    Every edge is within the radius; in small buckets all pairs are edges, in
    large ones a chain of shared words stands for them.
    """
    if radius % 2:
        raise ValueError("the linear way needs an even radius")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    counts = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    counts = store(counts, "buckets")
    few = counts.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    some = rows.join(counts.where(f"n > 2 and n <= {bucket}").select("t", "key"), ["t", "key"])
    groups = some.groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most `bucket` each
    pairs = groups.select(F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(
        F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: F.bit_count(x.bitwiseXOR(y)) <= radius),
        lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    near = few.unionByName(pairs).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    large = rows.join(counts.where(f"n > {bucket}").select("t", "key"), ["t", "key"]).select("fp").distinct()
    return near.unionByName(_through_words(large, radius // 2))


def _through_words(fps: DataFrame, half: int) -> DataFrame:
    """Link all fingerprints that are at most ``half`` bits from a common word, by the smallest of them."""
    around = [0]
    for _ in range(half):
        around = sorted({x ^ 1 << i for x in around for i in range(64)} | set(around))
    words = F.explode(F.array(*[F.lit(_signed(x)).cast("bigint") for x in around]))
    rows = fps.select("fp", words.alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("word"))
    least = rows.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    least = store(least, "words")
    two = least.where("n = 2").select("a", "b")
    more = rows.join(least.where("n > 2").select("word", "a"), "word").where("a <> fp").select("a", F.col("fp").alias("b"))
    return two.unionByName(more)


def _rooted(own: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, least)``: the smallest fingerprint reachable from each, and the smallest id of each."""
    nodes = store(own.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    linked = components(links(nodes.select("fp"), radius))
    return nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``id``, ``fp`` and ``component_id``, the smallest id reachable by links."""
    own = store(fingerprints(docs, id_col, text_col, size), "fingerprints")
    rooted = _rooted(own, radius)
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(rooted.join(best, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the smallest id (null ids last), then fingerprint and hash of the text; of repeated rows one stays.

    Documents are told by id and text, so an id that stands for several texts keeps the text that was chosen.
    """
    own = store(fingerprints(docs, id_col, text_col, size), "fingerprints")
    root = store(_rooted(own, radius).select("fp", "root"), "roots")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "tkey")
    best = own.groupBy("fp").agg(F.min(order).alias("d")).join(root, "fp").groupBy("root").agg(F.min("d").alias("d"))
    keys = ["__none", "__id", "__text"]  # the join and the choice among repeated rows share one shuffle
    chosen = store(best.select(F.col("d.none").alias("__none"), F.coalesce("d.id", F.lit(0)).alias("__id"), F.col("d.tkey").alias("__text")), "kept")
    own_id = F.col(id_col).cast("bigint")
    told = docs.select("*", own_id.isNull().alias("__none"), F.coalesce(own_id, F.lit(0)).alias("__id"), F.xxhash64(text_col).alias("__text"))
    kept = told.join(chosen, keys, "left_semi")
    rows = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("__row", F.row_number().over(rows)).where("__row = 1").select(*docs.columns)
