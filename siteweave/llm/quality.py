"""Quality classifier from weak labels: expectation-maximisation over heuristics, then a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document.  Votes are
counted by pattern over all documents; there are at most ``3 ** labellers``
patterns, so the counts are small whatever the corpus.  Expectation-maximisation
over the patterns estimates how each labeller votes on good and on bad documents
and gives every pattern a posterior of being good.  The posteriors of a bounded
sample of documents (``SAMPLE`` rows, those with the smallest keyed hash of the
text) train a logistic scorer over hashed byte trigrams, and the scorer judges
all documents by their whole text.  A document is kept if the mean of score and
posterior is at least one half.

Defined cases: a null, empty or blank text gets no votes, has no trigrams,
scores 0 and is not kept; repeated rows score alike; where nothing can be
trained (an empty table, one class) the posterior is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm import scan
from siteweave.llm.store import store

#: width of the hashed features; rows a scorer is fitted on
BITS, SAMPLE = 15, 3000
LABELLERS = ("symbols", "capitals", "repetition", "adjacent", "cells", "sentences", "plain", "digits")
GOOD, BAD, NONE = 2, 0, 1
# fixed values: below the first bound good, from the second on bad, in between no vote
BOUNDS = {"symbols": (0.02, 0.06), "capitals": (0.2, 0.4), "repetition": (0.4, 0.65), "adjacent": (0.05, 0.2), "cells": (0.05, 0.15),
          "sentences": (0.6, 0.9), "plain": (0.85, 0.95), "digits": (0.05, 0.2)}
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*!<>{}[]\\^~=+@_"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER, _LOWER, _DIGIT, _END = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_END[[ord(c) for c in ".?!"]] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of each labeller on each document of a slice."""
    start, end, doc = scan.words(data, offsets, ~scan.SPACE)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    n_words, n_bytes = np.diff(bounds).astype(np.float64), np.maximum(np.diff(offsets), 1).astype(np.float64)
    some = np.maximum(n_words, 1)
    size = end - start
    share = np.zeros((len(LABELLERS), len(offsets) - 1))
    share[0] = _sums(_MARKS[data], offsets) / n_bytes
    upper, lower = _sums(_UPPER[data], offsets), _sums(_LOWER[data], offsets)
    share[1] = upper / np.maximum(upper + lower, 1)
    hashes = scan.A.span(scan.A.prefix(data), start, end) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(offsets) - 1)
    # running text of n words has about n ** 0.75 distinct ones; the share of that which is missing
    share[2] = 1 - np.minimum(distinct / some ** 0.75, 1)
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    share[3] = _sums(again, bounds) / some
    share[4] = _sums((size == 1) & ~_LETTER[data[start]] & ~_DIGIT[data[start]], bounds) / some
    # a sentence in 30 words
    share[5] = 1 - np.minimum(_sums(_END[data[np.maximum(end - 1, 0)]], bounds) * 30 / some, 1)
    # short words of small letters, as function words are; not those that follow themselves
    small = np.concatenate([[0], np.cumsum(_LOWER[data] | (data >= 128))])
    share[6] = 1 - _sums((size <= 4) & (small[end] - small[start] == size) & ~again, bounds) / some
    share[7] = _sums(_DIGIT[data], offsets) / n_bytes
    out = np.full(share.shape, NONE, np.int8)
    for k, name in enumerate(LABELLERS):
        out[k][share[k] < BOUNDS[name][0]] = GOOD
        out[k][share[k] >= BOUNDS[name][1]] = BAD
    out[:, n_words == 0] = NONE
    out[2:7, n_words < 30] = NONE  # too short to tell
    return out


def pattern_of(found: np.ndarray) -> np.ndarray:
    return (found.astype(np.int64) * 3 ** np.arange(len(found))[:, None]).sum(axis=0)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pattern)`` of every document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in scan.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pattern_of(votes(data, offsets)))], ["id", "pattern"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {dict(docs.dtypes)[id_col]}, pattern bigint")


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good by pattern, and the rates ``[labeller, class, vote]`` among votes cast.

    Starts from the majority of votes; labellers are taken as independent given
    the class.  Rates are smoothed by one document of each vote.
    """
    if not counts:
        return {}, np.ones((len(LABELLERS), 2, 3))
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], np.float64)
    cast = np.stack([patterns // 3 ** k % 3 for k in range(len(LABELLERS))])
    bad, good = (cast == BAD).sum(axis=0), (cast == GOOD).sum(axis=0)
    # labellers look for faults of different kinds, so one sure fault outweighs what the others do not see
    good_rate = np.clip(0.95 - 0.45 * bad, 0.05, 0.95) * (bad + good > 0) + 0.5 * (bad + good == 0)
    posterior = good_rate
    rates = np.ones((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        share = np.stack([n * (1 - posterior), n * posterior])
        prior = (share.sum(axis=1) + 1) / (n.sum() + 2)
        for k in range(len(LABELLERS)):
            for v in (BAD, GOOD):  # no vote says nothing, it is not a vote of a third kind
                rates[k, :, v] = (share[:, cast[k] == v].sum(axis=1) + 1) / (share[:, cast[k] != NONE].sum(axis=1) + 2)
            rates[k, :, NONE] = 1
        logs = np.log(prior)[:, None] + sum(np.log(rates[k][:, cast[k]]) for k in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return dict(zip(patterns.tolist(), posterior.tolist())), rates


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of a slice and the bounds of each document's."""
    size = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(offsets[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
    x = data.astype(np.uint32)
    code = x[at] << 16 | x[at + 1] << 8 | x[at + 2]
    return (code * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64), bounds


def features(rows: DataFrame) -> DataFrame:
    """Pattern, hashed trigrams and their shares of the texts in ``rows``; at most ``2 ** BITS`` entries a text, however long."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in scan.slices(batches, "text"):
            patterns = pattern_of(votes(data, offsets))
            grams, bounds = trigrams(data, offsets)
            found = [np.unique(grams[lo:hi], return_counts=True) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(patterns), pa.array([g.astype(np.int32).tobytes() for g, _ in found], pa.binary()),
                pa.array([(n / max(n.sum(), 1)).astype(np.float32).tobytes() for _, n in found], pa.binary())], ["pattern", "grams", "shares"])

    return rows.select("text").mapInArrow(task, "pattern bigint, grams binary, shares binary")


def fit(texts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray | None:
    """Weights over hashed trigrams, intercept last; both classes weigh the same.  Texts are trigrams and shares."""
    if not len(texts) or target.max(initial=0) < 0.5 or target.min(initial=1) >= 0.5:
        return None
    rows = [np.full(len(g), i, np.int32) for i, (g, _) in enumerate(texts)]
    columns, values = [g for g, _ in texts], [v for _, v in texts]
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    scale = 100.0  # trigram shares are small
    value = value * scale
    good = target >= 0.5
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    w, b, m, v, mb, vb = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], len(texts)) + b
        error = weight * (1 / (1 + np.exp(-z)) - target)
        gradient = np.bincount(column, value * error[row], 1 << BITS) + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        step = rate / 10 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return np.append(w * scale, b)


def score(docs: DataFrame, weights: np.ndarray | None, posterior: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, posterior, score, kept)`` of every document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(3 ** len(LABELLERS), 0.5)
        table[list(posterior)] = list(posterior.values())
        for rows, data, offsets in scan.slices(batches, "text"):
            known = table[pattern_of(votes(data, offsets))]
            grams, bounds = trigrams(data, offsets)
            n = np.diff(bounds)
            if weights is None:
                judged = known.copy()
            else:
                z = _sums(weights[grams], bounds) / np.maximum(n, 1) + weights[-1]
                judged = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            blank = np.bincount(scan.words(data, offsets, ~scan.SPACE)[2], minlength=len(n)) == 0
            judged[n == 0] = known[n == 0]
            judged[blank] = 0.0
            kept = ~blank & (judged + known >= 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(known), pa.array(judged), pa.array(kept)], [id_col, "posterior", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"`{id_col}` {dict(docs.dtypes)[id_col]}, posterior double, score double, kept boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Weak labels, estimation, training and scoring: one row per document."""
    patterns = store(labelled(docs, id_col, text_col).groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    posterior, _ = estimate({r.pattern: r.n for r in patterns.collect()})
    # the sample's bound is a hash, found on hashes alone; then only the sampled texts move, and only as features to the driver
    rows = docs.where(F.trim(text_col) != "").select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("turn"))
    bound = rows.select("turn").distinct().orderBy("turn").limit(sample).agg(F.max("turn")).first()[0]
    held = features(rows.where(F.col("turn") <= bound).dropDuplicates(["turn"])).collect() if bound is not None else []
    held.sort(key=lambda r: (r.pattern, bytes(r.grams), bytes(r.shares)))  # any order of rows fits the same weights
    texts = [(np.frombuffer(r.grams, np.int32), np.frombuffer(r.shares, np.float32)) for r in held]
    target = np.array([posterior.get(r.pattern, 0.5) for r in held])
    return score(docs, fit(texts, target), posterior, id_col, text_col)
