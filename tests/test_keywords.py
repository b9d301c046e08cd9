"""Keywords found in one pass, against one test per keyword."""

import random

from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.keywords import Keywords
from siteweave.operators import business as B
from siteweave.plans import summary as S

WORDS = ["app", "application", "apple pie", "pie", "plication", "e p", "a.b", "c++", "+", "(x", "é", "日本", "日本語", "aa", "aaa"]
GROUPS = {"one": WORDS[:7], "two": WORDS[5:], "three": ["app", "aaa"]}


def test_masks_equal_one_test_per_keyword(spark):
    rng = random.Random(2)
    texts = ["application", "apple pie", "my apps", "aaaa", "a", "", None, "日本語", "日本", "axb", "c++", "(x é"]
    texts += ["".join(rng.choice(["app", "licat", "ion", "le", " p", "ie", "a", "é", "日本", "語", "+", "c", ".", "b", " "]) for _ in range(30)) for _ in range(200)]
    known = Keywords(*GROUPS.values())
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", known.found("text").alias("found"))
    rows = df.select("text", *[known.mask("found", w).alias(f"m_{n}") for n, w in GROUPS.items()], *[known.any_of("found", w).alias(f"a_{n}") for n, w in GROUPS.items()]).collect()
    for r in rows:
        for name, words in GROUPS.items():
            want = None if r.text is None else sum(1 << i for i, w in enumerate(words) if w in r.text)
            assert r[f"m_{name}"] == want and r[f"a_{name}"] == (None if want is None else want > 0), r


def test_industries_read_each_text_once(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("site_id"), "text")
    plan = B.industries(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "contains(" not in plan.lower() and "Python" not in plan
    signals = texts.selectExpr("site_id", "1L AS page_id", "text", "array('') AS anchors", "0.1D AS load_time", "false AS video_marker")
    plan = S.text_facts(signals, 2026)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=(") == 1
    assert len(Keywords(*K.INDUSTRY_KEYWORDS.values()).words) > 50
