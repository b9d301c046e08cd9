"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors of a label are one class.  Classes are cut into tiles of about
``TILE`` along a projection, so that a tile covers a narrow range of angles to
a few fixed pivots.  By the triangle inequality of angles two tiles can hold a
pair above the threshold only if their ranges are close for every pivot; other
pairs of tiles are left out.

Within a pair of tiles unit vectors are quantised to 8 bits, ``x = s q + e``,
and the product of the ``q`` bounds every cosine from above by
``s s' q.q' + |e'|(1 + |e|) + |e|(1 + |e'|) + |e||e'|``.  Only pairs whose bound
reaches the threshold are computed again in double precision.  A pair of tiles
sends sums of links per vector and a spanning forest, never its pairs.

Defined cases: vectors that are null, empty or zero or hold null or non-finite
components, and rows with a null label or id, link with nothing and keep
themselves; vectors of other lengths do not link; equal rows are copies of one
class and link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.components import components
from siteweave.llm.store import buckets, store

THRESHOLD, TILE, PIVOTS = 0.93, 1024, 6
#: cells of the first projection from which tiles are put together
CELLS = 4096
#: pairs of tiles in a task
TASK = 16


def pivots(dim: int, n: int = PIVOTS) -> np.ndarray:
    x = np.random.default_rng(dim).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def angles(rows: DataFrame) -> DataFrame:
    """Add ``angles``: the angle of each vector to the pivots of its length."""
    schema = rows.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = schema.names.index("embedding")
        for b in batches:
            sizes = np.diff(np.asarray(b.column(place).offsets))
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                x = _matrix(part.column(place)).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                seen = np.arccos(np.clip(x @ pivots(int(dim)).T, -1, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, seen.size + 1, PIVOTS), pa.int32()), pa.array(seen.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*schema.names, "angles"])

    return rows.mapInArrow(task, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", angles array<double>")


def tiles(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per tile: its ranges of angles and its classes, at most about ``2 * tile`` of them."""
    group = ["label", "dim"]
    cell = F.least(F.floor(F.get("angles", F.lit(0)) / F.lit(float(np.pi)) * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = store(angles(classes).withColumn("cell", cell), "angles")
    counts = rows.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
    # a cell never shares a tile with one it would fill beyond the limit; a large cell is cut by hash
    counts = counts.select(*group, "cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / tile).alias("t"), F.ceil(F.col("n") / tile).alias("parts"))
    dealt = rows.join(counts, [*group, "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = dealt.withColumn("tile", F.when(F.col("parts") > 1, F.concat_ws(".", "t", "cell", "part")).otherwise(F.concat_ws(".", "t")))
    ranges = [f(F.get("angles", F.lit(k))).alias(f"{name}{k}") for k in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))]
    members = F.sort_array(F.collect_list(F.struct("rep", "copies", "embedding"))).alias("members")
    return store(dealt.groupBy(*group, "tile").agg(members, *ranges), "tiles")


def tile_pairs(made: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of tiles of a label that may hold a pair of vectors above the threshold."""
    reach = float(np.arccos(threshold)) + 1e-6
    left = made.drop("members").withColumnRenamed("tile", "a")
    right = made.select("label", "dim", F.col("tile").alias("b"), *[F.col(f"{x}{k}").alias(f"{x}{k}_") for k in range(PIVOTS) for x in ("lo", "hi")])
    near = F.lit(True)
    for k in range(PIVOTS):
        near = near & (F.col(f"lo{k}") <= F.col(f"hi{k}_") + reach) & (F.col(f"lo{k}_") <= F.col(f"hi{k}") + reach)
    return left.join(right, ["label", "dim"]).where((F.col("a") <= F.col("b")) & near).select("label", "dim", "a", "b")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers up to 127, scale and length of the error of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def possible(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the pairs of unit vectors whose cosine may reach the threshold."""
    (q, s, e), (r, t, f) = quantised(x), quantised(y)
    product = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, x.shape[1], 512):  # sums of 512 products of 8-bit numbers are exact in single precision
        product += q[:, k: k + 512].astype(np.float32) @ r[:, k: k + 512].astype(np.float32).T
    bound = product * np.outer(s, t) + (np.outer(1 + e, f) + np.outer(e, 1 + f) + np.outer(e, f))
    return bound >= threshold - 1e-6


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose cosine in double precision reaches the threshold."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    mask = possible(x / nx[:, None], y / ny[:, None], threshold)
    i, j = np.nonzero(mask)
    if len(i) > mask.size // 16:
        return np.nonzero(mask & (x @ y.T >= threshold * np.outer(nx, ny)))
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k: k + 65536]], y[j[k: k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    keep = exact / (nx[i] * ny[j]) >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches by the links."""
    least = np.arange(n)
    while len(i):
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least


def compare(joined: DataFrame, threshold: float) -> DataFrame:
    """Per pair of tiles: links per class (``b`` null) and forest edges (``n`` null)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for k in (2, 3):
                    members = batch.column(k).slice(row, 1).flatten()
                    rep, copies, vectors = members.flatten()
                    sides.append((rep.to_numpy(), copies.to_numpy(), _matrix(vectors)))
                (ra, ca, x), (rb, cb, y) = sides
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                i, j = linked(x, y, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                ids = np.concatenate([ra, rb])
                a, b = i, j if same else len(ra) + j
                n = np.bincount(a, cb[j], len(ids)) + np.bincount(b, ca[i], len(ids))
                least = forest(a, b, len(ids))
                has, moved = np.flatnonzero(n), np.flatnonzero(least != np.arange(len(ids)))
                none = pa.nulls(len(has), pa.int64()), pa.nulls(len(moved), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(ids[has]), pa.array(ids[moved])]),
                    pa.concat_arrays([none[0], pa.array(ids[least[moved]])]),
                    pa.concat_arrays([pa.array(n[has].astype(np.int64)), none[1]])], ["a", "b", "n"])

    return joined.select("a", "b", "left", "right").mapInArrow(task, "a bigint, b bigint, n bigint")


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id`` and ``kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    good = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("embedding"), good.alias("good"))
    rows = rows.withColumn("twin", F.when(F.col("good"), F.md5(F.to_json(F.struct("label", "embedding")))))
    plain = F.struct(F.col("id").cast("bigint").alias("id"), "label", "embedding")
    classes = rows.where("good").groupBy("twin").agg(F.min(plain).alias("first"), F.count("*").alias("copies")).select(
        F.monotonically_increasing_id().alias("rep"), "twin", F.col("first.id").alias("least"), "copies", F.col("first.label").alias("label"), F.col("first.embedding").alias("embedding"),
        F.size("first.embedding").alias("dim"))
    classes = store(classes, "classes")  # classes have numbers of their own, for an id may occur with several vectors
    made = tiles(classes.drop("twin", "least"), tile)
    pairs = store(tile_pairs(made, threshold), "tile_pairs")
    n = pairs.count()
    side = made.select("label", "dim", "tile", "members")
    joined = pairs.join(side.withColumnsRenamed({"tile": "a", "members": "left"}), ["label", "dim", "a"]).join(
        side.withColumnsRenamed({"tile": "b", "members": "right"}), ["label", "dim", "b"]).repartition(max(buckets(rows), -(-n // TASK)))
    found = store(compare(joined, threshold), "links")
    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("twin", "rep", "least", "copies").join(links, "rep", "left").join(roots, "rep", "left").select(
        "twin", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = store(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    out = rows.select("id", "twin").join(store(named.join(smallest, "root").drop("root", "least"), "components"), "twin", "left")
    component = F.coalesce("smallest", F.col("id").cast("bigint"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
