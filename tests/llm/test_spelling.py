"""Spelling variants against a plain version, on planted edits and odd tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siteweave.llm import spelling
from tests.llm.brute import lower

import regex

RUN = regex.compile("[A-Za-zÀ-ÿ]+")


def plain_words(docs, letters=6, least=5, typo=199):
    found = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typo == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(known, ratio=5):
    near = {w: [v for v in known if one_edit(w, v)] for w in known}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= ratio * known[w] else None
    out = []
    for w, n in known.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vocabulary():
    """Words over few letters, so that many are near and many are anagrams; edits of them; chains of growing counts."""
    rng = random.Random(3)
    found = {}
    while len(found) < 700:
        found["".join(rng.choice("abñé") for _ in range(rng.choice([6, 6, 7, 7, 8])))] = rng.choice([5, 6, 30, 200, 900])
    found |= {"chainaa": 5, "chainab": 25, "chainbb": 125, "chainbbb": 625, "alone" * 3: 9, "z" * 300: 5, "z" * 301: 50, "×÷ßÿàþ": 5, "×÷ßÿàÞ": 25}
    return found


@pytest.mark.parametrize(("leaf_bytes", "sample"), [(2 << 20, 1 << 17), (4000, 1 << 17), (4000, 50)])
def test_variants(spark, vocabulary, leaf_bytes, sample):
    known = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")
    assert rows(spelling.variants(known, leaf_bytes=leaf_bytes, sample=sample)) == plain_variants(vocabulary)


def test_anagrams_are_dealt_over_tasks(spark):
    """Words of one letter multiset share a box that no split divides."""
    rng = random.Random(8)
    found = {}
    while len(found) < 400:
        w = list("aaabbbccc")
        rng.shuffle(w)
        found["".join(w)] = 5
    found |= {w[:4] + "d" + w[5:]: 60 for w in list(found)[:40]} | {w[1:]: 7 for w in list(found)[:40]}
    known = spark.createDataFrame(list(found.items()), "word string, n bigint")
    forest = spelling.plant(known, leaf_bytes=8000)
    assert max(forest.parts[9]) > 1
    assert rows(spelling.variants(known, leaf_bytes=8000)) == plain_variants(found)


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 4, (3000, 8)).astype(np.int32), axis=0)
    tree = spelling.Tree.build(points, 8)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(len(points)))
    asked = points[:200]
    q, leaf = tree.search(asked, 1, 1)
    assert len(q) < 0.6 * len(asked) * len(tree.members)
    reached = {(int(i), int(m)) for i, k in zip(q, leaf) for m in tree.members[k]}
    for i, v in enumerate(asked):
        step = points - v
        want = np.flatnonzero((np.maximum(step, 0).sum(1) <= 1) & (np.maximum(-step, 0).sum(1) <= 1))
        assert {(i, int(m)) for m in want} <= reached


def test_words_of_documents(spark):
    rng = random.Random(4)
    stems = ["Running", "runninG", "Éclairs", "éclairs", "straße", "naïveté", "abcdef", "short", "abcdefg"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", ".", "9", "_"]) for _ in range(200))) for i in range(60)]
    docs += [(None, "abcdef " * 30), (None, None), (7, ""), (3, docs[3][1]), (3, docs[3][1]), (99, "x" * 100_000 + " " + "longword " * 50_000)]
    table = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id bigint, text string, word string, n int, h int")
    got = {r.word: r.n for r in spelling.words(table).collect()}
    assert got == plain_words(docs)
    assert any(len(w) == 5 + 1 for w in got) and len(got) > 9
    assert rows(spelling.variants(spelling.words(table))) == plain_variants(got)


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(spelling.variants(spelling.words(table))) == []
    table = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert rows(spelling.variants(spelling.words(table))) == []
