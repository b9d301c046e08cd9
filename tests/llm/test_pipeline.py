"""run() and its stages against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siteweave.llm import pii
from tests.llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_entities int, lang_pred int"
VOCAB = {"en": "the of and house with river stone from water long".split(), "de": "der und das nicht haus mit wasser über fluss lang".split()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "given", 7, 8) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(VOCAB[lang]) + str(rng.randint(0, 30)) for _ in range(rng.choice([5, 40, 80]))), lang, f"s{i % 4}"))
    item = " ".join(f"bench{k} word" for k in range(10))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[3][1].upper(), "en", "s2"), (102, None, "en", "s0"), (103, "", None, None), (104, "123 456 !", "en", "s0"),
             (105, item + " of the house", "en", "s3"), (106, "some words " * 200 + item.split("bench3")[0], "en", "s3"), (107, "a", "en", None),
             (108, "Write to anna.weber@example.org or call +49 30 1234567, says Mrs Weber about her house and the river.", "en", "s1"),
             (109, "The card 4111 1111 1111 1111 of Mr Smith lies beside the stone at 10.1.2.3 in the water of the house.", "en", "s0"),
             (7, rows[8][1] + " tail of a repeated id", "en", "s1"), (None, rows[4][1], "de", "s0"), (None, "alone without any id in the house by the river", "en", "s2"),
             (None, "alone without any id in the house by the river", "en", "s2"), (5, rows[5][1], rows[5][2], rows[5][3]), (110, "long " * 300_000, "en", "s3")]
    folder = tmp_path_factory.mktemp("corpus")
    table(spark, rows).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    return rows, item, str(folder)


def plain_stages(rows, item):
    known = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    yield known
    prints = [brute.fingerprint(t) for _, t, _, _ in known]
    root = brute.roots(list(range(len(known))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(known[k])
    yield [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def ids(rows):
    return Counter(r[0] for r in rows)


def test_stages(spark, corpus):
    rows, item, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = plain_stages(rows, item)
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and {(r.score, r.n_entities, r.lang_pred) for r in out.collect()} == {("given", 7, 8)}
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name in ("language_id", "simhash_near_dedup"):
            assert Counter(got) == Counter((i, t) for i, t, _, _ in next(plain)), name
        if name == "benchmark_decontamination":
            judged = brute.decontaminated(texts, [(1, item)])
            assert Counter(i for i, _ in got) == Counter(r[0] for r in judged if not r[5]) and 105 not in {i for i, _ in got} and 106 in {i for i, _ in got}
        if name == "pii_surrogates":
            before, after = dict(texts), {r.doc_id: r for r in out.collect()}
            assert len(got) == len(texts)
            for i, text in before.items():
                found = [v for _, _, _, v in pii.find(text)]
                now = after[i].text
                assert after[i].n_chars == len(now) and (now == text if not found else now != text)
                assert not any(v in now for v in found)
            assert {i for i, t in before.items() if after[i].text != t} == {108, 109}
        texts, docs = got, out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    sizes = Counter((r.doc_id, r.source, len(brute.WORD.findall(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r.size) for r in last) == sizes
    per_source, taken = Counter(), Counter()
    for r in last:
        per_source[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in last:
        assert r.source_size == per_source[r.source] and abs(taken[r.source] - r.target) <= 1
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda rows_: sorted((str(r.doc_id), r.size, r.taken) for r in rows_)
    assert key(whole) == key(last)


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
