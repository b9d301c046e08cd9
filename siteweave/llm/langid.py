"""Language ID by rank-order profiles of character n-grams.

Training counts the n-grams (1 to 3 letters, words padded by a space) of all
training texts per language; the ``k`` most frequent, in order, are the
language's profile.  A document's own ``k`` most frequent n-grams are compared
to each profile by the out-of-place distance: the sum of rank differences,
``k`` for an n-gram the profile lacks.  The nearest profile wins; ties go to
the smaller name.  ``score`` is 1 minus the distance over its maximum.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text where nothing was learned; rows with a null label or text teach
nothing; equal counts rank by n-gram.  Whole texts count, of any length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.llm import scan
from siteweave.llm.store import store

K = 400
SPACE = 32
FLUSH = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``' word word '`` per text, other characters as one space; and the bounds."""
    low = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in low])])
    keep[bounds[:-1][bounds[:-1] < len(codes)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], total[bounds]


class Grams:
    """N-grams of one slice as small integers over the slice's own alphabet."""

    def __init__(self, texts: list[str]) -> None:
        codes, self.bounds = _codes(texts)
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        seen[SPACE] = True
        self.alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.int64)
        number[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.size = len(self.alphabet) + 1
        self.x, self.space = number[codes], int(number[SPACE])

    def of(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of ``x[start:end]`` and their counts."""
        x = self.x[start:end]
        a = x[x != self.space]
        two = x[:-1] * self.size + x[1:]
        three = (two[:-1] * self.size + x[2:])[x[1:-1] != self.space] if len(x) > 2 else two[:0]
        every = np.concatenate([a, two, three])
        top = self.size ** 3
        if top < 4 * len(every):
            counts = np.bincount(every, minlength=1)
            grams = np.flatnonzero(counts)
            return grams, counts[grams]
        return np.unique(every.astype(np.int32) if top < 1 << 31 else every, return_counts=True)

    def packed(self, grams: np.ndarray) -> np.ndarray:
        """N-grams as code points of 21 bits each, first letter highest."""
        g = grams.astype(np.int64)
        points = np.concatenate([[0], self.alphabet]).astype(np.int64)
        a, b, c = g // self.size ** 2, g // self.size % self.size, g % self.size
        return points[a] << 42 | points[b] << 21 | points[c]


def count_grams(texts: DataFrame) -> DataFrame:
    """``(lang, text)`` rows to ``(lang, gram, n)`` over all rows, combined in each task before the shuffle."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            grams, n = merged(kept.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for rows, _, _ in scan.slices(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams = Grams(texts)
                # texts follow each other with their padding; a pair of paddings is no n-gram
                found, n = grams.of(0, len(grams.x))
                real = found != grams.space * grams.size + grams.space
                kept.setdefault(lang, []).append((grams.packed(found[real]), n[real]))
                if sum(len(g) for g, _ in kept[lang]) > FLUSH:
                    kept[lang] = [merged(kept[lang])]
                    if len(kept[lang][0][0]) > FLUSH // 2:
                        yield out(lang)
        for lang in list(kept):
            yield out(lang)

    parts = texts.mapInArrow(task, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(train: DataFrame, k: int = K) -> DataFrame:
    """``(lang, text)`` to the profiles ``(lang, gram, rank)``, rank from 0."""
    counts = count_grams(train.where("lang is not null and text is not null").select("lang", "text"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).drop("n")


def learned(table: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Profiles as sorted n-grams and a rank matrix; bounded by languages times ``k``."""
    rows = table.collect()
    langs = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(langs), len(grams)), -1, np.int64)
    if rows:
        ranks[[langs.index(r.lang) for r in rows], np.searchsorted(grams, [r.gram for r in rows])] = [r["rank"] for r in rows]
    return langs, grams, ranks


def nearest(text: str | None, model: tuple[list[str], np.ndarray, np.ndarray], k: int = K) -> tuple[str, float]:
    """Language and score of one text."""
    return _nearest(Grams([text or ""]), 0, model, k)


def _nearest(slice_grams: Grams, i: int, model: tuple[list[str], np.ndarray, np.ndarray], k: int) -> tuple[str, float]:
    langs, known, ranks = model
    start, end = slice_grams.bounds[i], slice_grams.bounds[i + 1]
    if end - start < 3 or not langs:
        return "und", 0.0
    grams, n = slice_grams.of(start, end)
    if len(n) > 4 * k:  # only counts that can be among the first k are sorted
        least = np.partition(n, len(n) - k)[len(n) - k]
        grams, n = grams[n >= least], n[n >= least]
    packed = slice_grams.packed(grams)
    packed = packed[np.lexsort((packed, -n))[:k]]
    at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
    rank = np.where(known[at] == packed, ranks[:, at], -1)
    far = np.where(rank < 0, k, np.abs(rank - np.arange(len(packed)))).sum(axis=1)
    best = int(np.argmin(far))
    return langs[best], float(1 - far[best] / (k * len(packed)))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", k: int = K) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in scan.slices(batches, text_col):
            grams = Grams([t or "" for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()])
            found = [_nearest(grams, i, model, k) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*rows.schema.names, "lang_pred", "score"])

    return base.mapInArrow(task, schema)


def held_out(id_col: str = "doc_id"):
    """Rows no profile is learned from: crc32 of the id as text, modulo 3, is 1; a null id is not held out but teaches nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", k: int = K) -> tuple[list[str], np.ndarray, np.ndarray]:
    train = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return learned(store(profiles(train, k), "profiles"))
