"""Depths of a link graph of all sites at once (LK17 without a cap on URLs).

Labels spread level by level from the main URLs.  Edges lie in a table bucketed by (site, source), labels in one bucketed by (site, URL), so a
level moves only the labels that are new: neither the edges nor what is known is shuffled.

Long chains ("next page" links) would cost a level per page.  After ``PLAIN`` levels the part of the graph that labels can still change is
contracted: links to pages whose label cannot improve any more are dropped, and runs of unlabelled pages with at most two neighbours, linked
in one direction or both, become single edges as long as the run.  Run lengths come from pointer doubling, so a run of n pages costs about
log2(n) rounds.  The walk goes on over the shorter graph, which is contracted again after as many levels; in the end every page of a run gets
the depth of the run's ends plus its distance from them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteweave.session import materialise, shared_folder

#: levels between two contractions
PLAIN = 8


@dataclass
class Bucketed:
    """A table below the shared folder, dealt into buckets by two columns; rows may be added."""

    spark: SparkSession
    name: str
    path: str
    keys: tuple[str, str]
    buckets: int
    begun: bool = False

    @classmethod
    def create(cls, spark: SparkSession, name: str, keys: tuple[str, str]) -> Bucketed:
        path = shared_folder(spark, name)
        return cls(spark, f"{name}_{uuid.uuid4().hex}", path, keys, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, rows: DataFrame) -> int:
        """Write rows and tell how many; those that a join or aggregate on the keys has dealt out already are not moved again."""
        told = Observation()
        rows = rows.observe(told, F.count(F.lit(1)).alias("n"))
        if self.begun:
            rows.write.insertInto(self.name)
        else:
            rows.write.option("path", self.path).bucketBy(self.buckets, *self.keys).saveAsTable(self.name)
            self.begun = True
        return told.get["n"]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table; its files go with the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def depths(starts: DataFrame, edges: DataFrame, max_depth: int | None = None, plain: int = PLAIN, trace: list[str] | None = None) -> DataFrame:
    """``(site_id, url, depth)`` of everything that links lead to from ``starts(site_id, url)`` over ``edges(site_id, source, url)``.

    ``trace`` collects the names of the rounds.
    """
    spark = starts.sparkSession
    trace = [] if trace is None else trace
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = edges.where("source <> url").select("site_id", "source", "url").distinct().withColumn("length", F.lit(1).cast("bigint"))
    graph = Bucketed.create(spark, "edges", ("site_id", "source"))
    graph.add(one.repartition(n, "site_id", "source"))
    labels = Bucketed.create(spark, "labels", ("site_id", "url"))
    labels.add(starts.select("site_id", "url", F.lit(0).cast("bigint").alias("depth"), F.lit(0).alias("round")).distinct().repartition(n, "site_id", "url"))
    runs: list[DataFrame] = []
    at = 0
    used = [graph, labels]
    while True:
        if at and at % plain == 0:
            shorter, inside = _contracted(graph.table(), labels.table(), at, trace)
            runs.append(inside)
            graph = Bucketed.create(spark, "edges", ("site_id", "source"))
            graph.add(shorter.repartition(n, "site_id", "source"))
            used.append(graph)
        trace.append("level")
        if not labels.add(level(graph.table(), labels.table(), at, max_depth)):
            break
        at += 1
    known = spark.read.schema("site_id string, url string, depth bigint").parquet(labels.path).groupBy("site_id", "url").agg(F.min("depth").alias("depth"))
    for inside in reversed(runs):
        known = materialise(known, "depths")
        reached = known.select("site_id", F.col("url").alias("anchor"), F.col("depth").alias("start"))
        found = inside.join(reached, ["site_id", "anchor"]).groupBy("site_id", "url").agg(F.min(F.col("start") + F.col("length")).alias("depth"))
        known = known.unionByName(found if max_depth is None else found.where(F.col("depth") <= max_depth))
    out = materialise(known, "depths")
    for t in used:
        t.drop()
    return out


def level(graph: DataFrame, labels: DataFrame, at: int, max_depth: int | None = None) -> DataFrame:
    """Labels that get lower by links from those of round ``at``."""
    fresh = labels.where(F.col("round") == at).select("site_id", F.col("url").alias("source"), "depth")
    found = fresh.join(graph, ["site_id", "source"]).select("site_id", "url", (F.col("depth") + F.col("length")).alias("depth"))
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    best = found.groupBy("site_id", "url").agg(F.min("depth").alias("depth"))
    known = labels.select(F.col("site_id").alias("known_site"), F.col("url").alias("known_url"), F.col("depth").alias("old"))
    same = (best["site_id"] == known["known_site"]) & (best["url"] == known["known_url"]) & (known["old"] <= best["depth"])
    return best.join(known, same, "left_anti").select("site_id", "url", "depth", F.lit(at + 1).alias("round"))


def _contracted(graph: DataFrame, labels: DataFrame, at: int, trace: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph that is left with its runs as single edges, and the pages inside runs: ``(site_id, url, anchor, length)``."""
    best = labels.groupBy("site_id", "url").agg(F.min("depth").alias("label"), F.max("round").alias("last"))
    # nothing that is found from now on lies below the fresh labels
    floor = labels.where(F.col("round") == at).groupBy("site_id").agg(F.min("depth").alias("floor"))
    best = materialise(best.join(floor, "site_id"), "labels")
    target = best.select("site_id", "url", F.col("label").alias("target"), F.col("floor").alias("floor_t"))
    source = best.select("site_id", F.col("url").alias("source"), F.col("label").alias("from"), "last", F.col("floor").alias("floor_s"))
    left = graph.join(target, ["site_id", "url"], "left").where("target is null or target > floor_t + length")
    left = left.join(source, ["site_id", "source"], "left").where(f"`from` is null or last = {at} or `from` > floor_s")
    # a site without fresh labels is done
    left = left.join(floor.select("site_id"), "site_id", "left_semi")
    left = materialise(left.select("site_id", "source", "url", "length", F.col("from").isNotNull().alias("from_known"), F.col("target").isNotNull().alias("known")), "left")
    trace.append("contract")
    sides = left.select("site_id", F.col("source").alias("page"), F.col("url").alias("other"), F.col("from_known").alias("known")).unionByName(
        left.select("site_id", F.col("url").alias("page"), F.col("source").alias("other"), "known"))
    pages = sides.groupBy("site_id", "page", "other").agg(F.bool_or("known").alias("known")).groupBy("site_id", "page").agg(
        F.bool_or("known").alias("known"), F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b"))
    inside = materialise(pages.where("not known and n <= 2").select("site_id", "page", "a", "b"), "inside")
    into = inside.select("site_id", F.col("page").alias("url"), F.lit(True).alias("into"))
    out_of = inside.select("site_id", F.col("page").alias("source"), F.lit(True).alias("out_of"), "a", "b")
    marked = materialise(left.join(into, ["site_id", "url"], "left").join(out_of, ["site_id", "source"], "left").select(
        "site_id", "source", "url", "length", F.col("into").isNotNull().alias("into"), F.col("out_of").isNotNull().alias("out_of"),
        F.when(F.col("url") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("before")), "marked")
    # a step into a run's page comes from an end of the run, or from the step before it: from the page's other neighbour
    steps = marked.where("into").select(
        "site_id", "source", "url", "length", F.when(~F.col("out_of"), F.col("source")).alias("anchor"),
        F.when(F.col("out_of") & (F.col("before") != F.col("url")), F.col("before")).alias("before"), F.col("source").alias("page"))
    steps = materialise(steps.where("anchor is not null or before is not null").select(
        "site_id", "source", "url", "length", "anchor", F.col("before").alias("to_source"), F.col("page").alias("to_url")), "steps")
    open_steps = steps.where("anchor is null").count()
    # a ring that nothing leads into never ends, and is not reached
    for _ in range((open_steps + 1).bit_length() + 1 if open_steps else 0):
        trace.append("double")
        open_ = steps.where("anchor is null")
        ahead = steps.select("site_id", F.col("source").alias("to_source"), F.col("url").alias("to_url"), F.col("length").alias("more"),
                             F.col("anchor").alias("end"), F.col("to_source").alias("next_source"), F.col("to_url").alias("next_url"))
        jumped = open_.join(ahead, ["site_id", "to_source", "to_url"]).select(
            "site_id", "source", "url", (F.col("length") + F.col("more")).alias("length"), F.col("end").alias("anchor"),
            F.col("next_source").alias("to_source"), F.col("next_url").alias("to_url"))
        told = Observation()
        jumped = jumped.observe(told, F.count_if(F.col("anchor").isNull()).alias("n"))
        steps = materialise(jumped.unionByName(steps.where("anchor is not null")), "steps")
        if not told.get["n"]:
            break
    ends = materialise(steps.where("anchor is not null").select("site_id", "source", "url", "anchor", "length"), "ends")
    # a run leads on to the page behind it, for whoever came in at the other side
    leaving = marked.where("out_of and not into").select("site_id", F.col("source").alias("url"), F.col("url").alias("target"), F.col("length").alias("more"))
    through = ends.join(leaving, ["site_id", "url"]).where("source <> target and anchor <> target").select(
        "site_id", F.col("anchor").alias("source"), F.col("target").alias("url"), (F.col("length") + F.col("more")).alias("length"))
    direct = marked.where("not into and not out_of").select("site_id", "source", "url", "length")
    shorter = direct.unionByName(through).groupBy("site_id", "source", "url").agg(F.min("length").alias("length"))
    return shorter, ends.select("site_id", "url", "anchor", "length")
