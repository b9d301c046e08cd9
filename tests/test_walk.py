"""Depths over graphs with long runs against a plain queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from checks import load
from checks.corpus import BASE_ID
from siteweave.operators import graph as G
from siteweave.operators import walk as W


def queue(starts, edges, max_depth=None):
    after = {}
    for site, a, b in edges:
        after.setdefault((site, a), set()).add(b)
    depth = {(s, u): 0 for s, u in starts}
    todo = deque(depth)
    while todo:
        site, u = todo.popleft()
        if max_depth is not None and depth[site, u] >= max_depth:
            continue
        for v in after.get((site, u), ()):
            if (site, v) not in depth:
                depth[site, v] = depth[site, u] + 1
                todo.append((site, v))
    return depth


def walked(spark, starts, edges, max_depth=None, plain=W.PLAIN):
    trace = []
    links = spark.createDataFrame(edges, "site_id string, source string, url string")
    out = W.depths(spark.createDataFrame(starts, "site_id string, url string"), links, max_depth, plain, trace)
    rows = out.collect()
    assert len({(r.site_id, r.url) for r in rows}) == len(rows)
    return {(r.site_id, r.url): r.depth for r in rows}, trace


def chain(site, names, back):
    pairs = list(zip(names, names[1:]))
    return [(site, a, b) for a, b in pairs] + ([(site, b, a) for a, b in pairs] if back else [])


def random_graph(seed):
    rng = random.Random(seed)
    edges, starts = [], []
    for site in ("x", "y"):
        hubs = [f"h{i}" for i in range(12)]
        starts.append((site, "h0"))
        edges += [(site, rng.choice(hubs), rng.choice(hubs)) for _ in range(14)] + [(site, "h0", "h1"), (site, "h0", "h2"), (site, "h0", "c1_0"), (site, "h1", "c2_0")]
        for c in range(6):  # runs between hubs, into nothing, and rings
            names = [f"c{c}_{i}" for i in range(rng.randint(1, 40))]
            ends = rng.choice([(True, True), (True, False), (False, True), (False, False)])
            path = [rng.choice(hubs)] * ends[0] + names + [rng.choice(hubs)] * ends[1]
            edges += chain(site, path, rng.random() < 0.5)
            edges += [(site, rng.choice(names), rng.choice(names + hubs)) for _ in range(rng.choice([0, 0, 1, 2]))]
            if not any(ends) and len(names) > 2:
                edges.append((site, names[-1], names[0]))
        shared = f"late{site}"
        edges += [(site, f"c0_{i}", shared) for i in range(20)] + [(site, shared, "h3"), (site, "h0", "h0")]
    return starts, edges + edges[:5]


@pytest.mark.parametrize(("seed", "plain", "max_depth"), [(1, 3, None), (3, 2, 9)])
def test_depths_equal_a_queue(spark, seed, plain, max_depth):
    starts, edges = random_graph(seed)
    got, trace = walked(spark, starts, edges, max_depth, plain)
    assert got == queue(starts, edges, max_depth)
    assert "contract" in trace


def test_a_long_chain_takes_few_rounds(spark):
    """3,000 pages, each with links to the next one and the one before, to the main page and to a page that only the later ones show."""
    names = [f"p{i}" for i in range(3_000)]
    edges = chain("s", names, True) + [("s", n, "p0") for n in names] + [("s", n, "about") for n in names[300:]]
    got, trace = walked(spark, [("s", "p0")], edges)
    assert got == queue([("s", "p0")], edges)
    assert len(trace) < 60 and trace.count("level") < 30


def test_plain_chain_rounds(spark):
    names = [f"p{i}" for i in range(10_000)]
    got, trace = walked(spark, [("s", "p0")], chain("s", names, False))
    assert got["s", "p9999"] == 9999 and len(got) == 10_000 and len(trace) < 40


def test_a_level_moves_neither_edges_nor_labels(spark):
    n = 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.range(2000).select(F.lit("s").alias("site_id"), F.col("id").cast("string").alias("source"), (F.col("id") * 7 % 1999).cast("string").alias("url"), F.lit(1).cast("bigint").alias("length"))
        graph, labels = W.Bucketed.create(spark, "edges", ("site_id", "source")), W.Bucketed.create(spark, "labels", ("site_id", "url"))
        assert graph.add(edges.repartition(n, "site_id", "source")) == 2000
        labels.add(edges.limit(9).select("site_id", "url", F.lit(0).cast("bigint").alias("depth"), F.lit(0).alias("round")))
        found = W.level(graph.table(), labels.table(), 0)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") >= 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_links_and_no_sites(spark):
    assert walked(spark, [("s", "a")], [])[0] == {("s", "a"): 0}
    assert walked(spark, [], [("s", "a", "b")])[0] == {}
    links = spark.createDataFrame([("s", "a", "b", 0)], "site_id string, source string, url string, link_seq int")
    rows = G.reach(spark.createDataFrame([("s", "a")], "site_id string, url string"), links).collect()
    assert sorted((r.url, r.depth, r.position, r.processed) for r in rows) == [("a", 0, None, True), ("b", 1, None, True)]


def test_page_records_hold_the_depth_of_every_page(spark, tmp_path):
    """Pages of a chain link to the next one; those behind the 45th have their depth too."""
    keys = [1 + 291 * i for i in range(60)]
    customers = [(k, f"Customer {k}", 1, 1.0, "BUILDING") for k in keys]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = load()["snk2_page_records"][0](spark, str(tmp_path)).collect()
    assert {r.page_id: r.depth for r in rows} == {BASE_ID + k: i for i, k in enumerate(keys)}
