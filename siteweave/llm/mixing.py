"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Every source has a weight and a schedule: its share of the stream changes
linearly over training time ``t`` in [0, 1] as ``1 + tilt * (2 t - 1)``, whose
integral is 1.  Its tokens demanded up to ``t`` are therefore
``target * (t + tilt * (t * t - t))``, and the position of a token is the
inverse of that at the token's place in its source.  Within a source documents
follow each other in the order of a keyed hash; a source whose target exceeds
its size is passed again, at most ``cap`` times.  The word the target ends at
ends the mix of that source, also inside a document.

A source's words are added up in ranges of the hash, then within a range: a
source with a third of all rows is spread over ``RANGES`` groups.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source, last in order; rows of equal hash (repeated or null ids) are ordered by
size and text; an empty table gives an empty result.  Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.store import store

WEIGHTS, TILTS, CAP, SEED = (5, 2, 1), (-0.5, 0.0, 0.5), 3, "curriculum"
#: groups a source is cut into, by the first three hexadecimal digits of the hash
RANGES = 4096


def _cycle(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, cap: float = CAP) -> DataFrame:
    """``(source, source_size)`` to targets: shares of all words by weight, none above ``cap`` times its size.

    What a capped source leaves is shared by the others by weight, until none is
    above.  In order of ``cap * size / weight`` the capped sources come first, so
    prefix sums give the level ``words per unit of weight`` at which the rest end.
    One row per source: this table is as small as the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(by_name))
    weighed = placed.withColumn("weight", _cycle(weights, F.col("place"))).withColumn("tilt", _cycle(tilts, F.col("place")))
    most = weighed.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = most.withColumn("total", F.sum("source_size").over(all_rows)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))
    first = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = levels.withColumn("end", first)
    return level.select("source", "source_size", "tilt", F.least("most", F.coalesce(F.col("end") * F.col("weight"), F.col("most"))).alias("target"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def position(place: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's demand reaches ``place`` words."""
    u = place / target
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)
    return F.when(tilt == 0, u).otherwise(2 * u / ((1 - tilt) + root))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS,
        tilts: Sequence[float] = TILTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``copies`` lists the passes that take words of the document, each with its
    training position and its words.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), key.alias("key"),
        F.substring(F.md5(F.coalesce(F.col(text_col), F.lit(""))), 1, 8).alias("tie"))
    # one pass over the texts; what follows reads ids, sizes and hashes
    rows = store(rows.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).withColumn("range", F.substring("key", 1, 3)), "sizes")
    ranges = rows.groupBy("group", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    ranges = store(ranges, "ranges")
    shares = targets(ranges.groupBy("group").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).drop("group"), weights, tilts, cap)
    shares = shares.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("group"), "source_size", "target", "tilt")
    ahead = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("group", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start")).join(shares, "group")
    inside = Window.partitionBy("group", "range").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        store(starts, "starts").hint("merge"), ["group", "range"])  # dealt by the window's keys already; never sent to all tasks
    copies = []
    for k in range(cap):
        place = F.col("start") + F.col("inside") + F.col("source_size") * k
        took = F.least(F.col("size"), F.greatest(F.floor(F.col("target") + 1e-6) - place, F.lit(0))).cast("bigint")
        copies.append(F.struct(position(place, F.col("target"), F.col("tilt")).alias("position"), took.alias("words")))
    copies = F.filter(F.array(*copies), lambda c: c["words"] > 0)
    out = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda acc, c: acc + c["words"])
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per pass of a document, range-sorted by training position."""
    each = mixed.select(id_col, "source", F.posexplode("copies").alias("copy", "c")).select(id_col, "source", "copy", "c.position", "c.words")
    return each.orderBy("position", id_col, "copy")


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents range-sorted by the position of their first pass; those that are not taken come last."""
    first = F.get("copies", F.lit(0))["position"]
    return mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), id_col)
