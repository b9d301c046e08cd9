"""Ranked search against a plain version; what pair bounds skip."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from siteweave.llm import search
from tests.llm.brute import ALNUM, lower

DOCS = "doc_id bigint, text string, item_id int, score string, rank int"


def plain_rank(docs, items, k=20):
    said = [(i, Counter(ALNUM.findall(lower(t)))) for i, t in docs]
    said = [(i, c, sum(c.values())) for i, c in said if c]
    total, length = len(said), sum(n for _, _, n in said)
    df = Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text in items:
        asked = Counter(ALNUM.findall(lower(text)))
        scores = []
        for i, c, n in said:
            m = 75 + (25 * n * total) // length
            s = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(120)] + ["É", "日本", "x", "9"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocab, weights, k=rng.choice([1, 3, 30, 90])))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .,"), (7, docs[7][1]), (7, "w1 w2"), (None, docs[3][1]), (None, "w100 w101"), (900, "w5 " * 30_000 + "w99")]
    items = [(k, " ".join(rng.choices(vocab, weights, k=12)).upper()) for k in range(25)]
    items += [(3, "w5 w99 w99"), (40, None), (41, ""), (42, "unknown words"), (43, "unknown w100"), (None, "w7")]
    return docs, items


@pytest.mark.parametrize(("item_bytes", "block", "paired"), [(1 << 20, 4096, 32), (1 << 20, 16, 32), (150, 40, 3), (1 << 20, 16, 0)])
def test_rank(spark, corpus, item_bytes, block, paired):
    docs, items = corpus
    table = spark.createDataFrame([(i, t, 1, "clash", 5) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, doc_id int")
    assert got(search.rank(table, bench, item_bytes=item_bytes, block=block, paired=paired)) == plain_rank(docs, items)


def test_ties_and_few_hits(spark):
    docs = [(i, "same text") for i in range(60, 0, -1)] + [(100, "other")]
    items = [(1, "same"), (2, "other other"), (3, "none")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = got(search.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block=8))
    assert found == plain_rank(docs, items)
    assert [r[2] for r in sorted(found) if r[0] == 1] == list(range(1, 21))


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty(spark, docs, items):
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert got(search.rank(table, bench)) == []


def _block(plan, rows):
    """Index block of documents given as term counts."""
    import pyarrow as pa

    n = np.array([sum(c.values()) for c in rows])
    doc = np.array([d for d, c in enumerate(rows) for _ in c])
    term = np.array([t for c in rows for t in c])
    count = np.array([x for c in rows for x in c.values()])
    return search.Block(plan, pa.array(range(len(rows))), n, doc, term, count)


def test_pair_bounds_skip_more_and_lose_nothing():
    rng = random.Random(2)
    # terms 0 and 1 are common and never meet; 2 is rarer, and its documents come first
    rows = [{rng.choice([0, 1]): rng.randint(1, 9), 3: rng.randint(1, 9)} for _ in range(400)] + [{2: 9}] * 100
    item = search.Item(0, np.array([0, 1, 2]), np.array([1, 1, 1]))
    df = np.array([sum(t in c for c in rows) for t in range(4)])
    weight = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * x + 1))) for x in df])
    pairs = search._pair_up([item], df, 32)
    plan = search.Plan([item], weight, pairs, len(rows), sum(sum(c.values()) for c in rows), 20, 50)
    results, looked = [], []
    for pair_bounds in (True, False):
        s = search.Searcher(plan, {}, pair_bounds)
        for k in range(len(rows) - 50, -1, -50):
            b = _block(plan, rows[k: k + 50])
            s.block(np.arange(k, k + len(b.ids)), b.bounds, b.terms, b.docs, b.impacts, b.most, b.pairs, b.joint)
        results.append([x.tolist() for x in s.best[0]])
        looked.append(s.looked)
    assert results[0] == results[1] and len(results[0][0]) == 20
    assert looked[0] < 0.7 * looked[1]


def test_joint_maxima():
    """A pair's stored maximum is that of its intersection list."""
    rng = random.Random(6)
    rows = [{t: rng.randint(1, 5) for t in rng.sample(range(12), rng.randint(1, 6))} for _ in range(200)] + [{50: 1, 51: 2}, {50: 3}]
    item = search.Item(0, np.array([*range(12), 50, 51]), np.ones(14, np.int64))
    df = np.ones(52, np.int64)
    pairs = search._pair_up([item], df, 32)
    plan = search.Plan([item], np.arange(52) + 1, pairs, len(rows), 1000, 20, 4096)
    b = _block(plan, rows)
    impact = {(int(t), int(d)): int(x) for k, t in enumerate(b.terms) for d, x in zip(b.docs[b.bounds[k]:b.bounds[k + 1]], b.impacts[b.bounds[k]:b.bounds[k + 1]])}
    stored = {tuple(pairs[p]): int(j) for p, j in zip(b.pairs, b.joint)}
    for x, y in map(tuple, pairs):
        both = [impact[x, d] + impact[y, d] for d in range(len(rows)) if (x, d) in impact and (y, d) in impact]
        assert stored.get((x, y)) == (max(both) if both else None)
