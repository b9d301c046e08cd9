"""SS1 over crawls that come bit by bit: mergeable states per day, summaries without reading old pages.

``store_day`` reads a day's pages once and stores, per site or per site and value, what the summary's columns come from: sums, minima of
structs, bit masks, flags, distinct values with their first page.  ``summary_of`` merges the states of any days and finishes the record; it
equals the summary of all their pages.  A day stored again replaces what it had.

Pages of different days have different ids.  One thing cannot be known on the day: that a later link names an old page an about page.  Where
such a page is a site's longest, its text is made then, from ``pages``, for those pages only; without ``pages`` such a site shows no text of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import urls as U
from siteweave.operators import contact as C
from siteweave.operators import dom as D
from siteweave.operators import links as L
from siteweave.operators import maps as M
from siteweave.operators import marketing as MK
from siteweave.operators import metadata as MD
from siteweave.operators import pages as P
from siteweave.operators import products as PR
from siteweave.operators.facts import first_values
from siteweave.operators.signals import page_signals
from siteweave.plans import summary as S
from siteweave.session import materialise

COUNTS = ["internal_links", "external_links", "social_links", "maps_links", "contact_links"]


def day_states(pages: DataFrame, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """The states of some accepted pages by name."""
    signals = materialise(page_signals(pages), "signals")
    links = materialise(L.page_links(signals), "links")
    found = materialise(M.all_maps(signals), "map_links")
    candidates = MD.about_candidates(signals)
    about_links = links.where("is_about").select("site_id", "url").distinct()
    named = candidates.join(about_links.withColumn("named", F.lit(True)), ["site_id", "url"], "left").where("own or named").select("page_id")
    body = pages.select("page_id", "url", "html")
    inside = F.when(F.col("link_type") == "internal", F.col("url"))
    offers = PR.cheapest_offers(PR.all_products(signals, pages))
    return {
        "text": S.text_state(signals),
        "first_pages": signals.groupBy("site_id").agg(F.min(F.struct("page_id", "url")).alias("min_first")),
        "link_counts": L.counts(links).select("site_id", *[F.col(c).alias(f"n_{c}") for c in COUNTS]),
        "link_urls": links.select("site_id", inside.alias("url")).groupBy("site_id", "url").agg(F.count("*").alias("n_links")),
        "maps": found.groupBy("site_id", "map_url", "method").agg(F.count("*").alias("n_found")),
        "contact_maps": M.contact_page_maps(found, P.page_kinds(signals)).withColumnRenamed("contact_page_maps", "n_contact"),
        "social": C.social_hits(signals).groupBy("site_id", "platform").agg(F.min(F.struct("page_id", "link_seq", "profile")).alias("min_at")),
        "brand": C.ld_names(signals).groupBy("site_id").agg(F.min(F.struct("page_id", "ld_seq", "name")).alias("min_at")),
        "phones": C.phone_rows(signals).groupBy("site_id", "kind", "phone").agg(F.min("page_id").alias("min_page")),
        "keywords": MD.keyword_rows(signals).groupBy("site_id", "keyword").agg(F.min("page_id").alias("min_page")),
        "videos": MK.videos(signals).select("site_id", "video_url", F.col("first_page").alias("min_page")),
        "offers": offers.select("site_id", "url", "name", F.struct("price", "currency").alias("min_offer")),
        "mains": _mains(pages, signals, seeds),
        "about_pages": candidates,
        "about_links": about_links,
        "about_texts": D.about_texts(D.parse(body.join(materialise(named, "about_named"), "page_id", "left_semi"))).select("page_id", "about_text"),
        "about_sections": D.about_sections(D.parse(body.join(materialise(signals.where("about_marker").select("page_id"), "about_marked"), "page_id", "left_semi"))),
    }


def _mains(pages: DataFrame, signals: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """The day's main page of each site and how it compares with those of other days."""
    mains = materialise(L.main_pages(signals, seeds), "mains")
    seeded = F.lit(1) if seeds is None else F.coalesce("seeded", F.lit(1))
    ranked = mains if seeds is None else mains.join(seeds.select("main_url", F.lit(0).alias("seeded")).distinct(), "main_url", "left")
    order = ranked.select("site_id", F.struct(seeded.alias("s"), "page_id").alias("order"))
    columns = S.main_columns(pages, signals, seeds)
    row = F.struct(*[c for c in columns.columns if c != "site_id"])
    return columns.join(order, "site_id").select("site_id", F.struct("order", row.alias("row")).alias("min_main"))


def store_day(pages: DataFrame, folder: str, day: str, seeds: DataFrame | None = None) -> None:
    """Store the states of a day's accepted pages, each as ``folder/<name>/day=<day>``; the mark of the day is set last."""
    for name, state in day_states(pages, seeds).items():
        state.write.mode("overwrite").parquet(f"{folder}/{name}/day={day}")
    pages.sparkSession.createDataFrame([(day,)], "day string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/days/day={day}")


def summary_of(spark: SparkSession, folder: str, as_of_year: int = 2026, analysis_date: str = "", days: list[str] | None = None,
               pages: DataFrame | None = None, lists: bool = True) -> DataFrame:
    """The record of every site over the stored days, or those named."""
    def stored(name: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/day=*")
        rows = rows.withColumn("day", F.col("day").cast("string"))
        ended = spark.read.parquet(f"{folder}/days/day=*").select(F.col("day").cast("string").alias("day"))
        kept = rows.join(F.broadcast(ended), "day", "left_semi")
        return (kept.where(F.col("day").isin(days)) if days is not None else kept).drop("day")

    mains = S.merged(stored("mains"), "site_id").select("site_id", "min_main.row.*")
    urls = S.merged(stored("first_pages"), "site_id").select("site_id", "min_first.url", F.lit(0).cast("bigint").alias("n_links")).unionByName(stored("link_urls"))
    per_url = S.merged(urls, "site_id", "url")
    pages_of = per_url.groupBy("site_id").agg(F.count("url").alias("total_pages"), F.sum("n_links").alias("total_links"))
    structure = pages_of.select("*", L.complexity(F.col("total_pages")).alias("complexity"), F.lit(0).cast("bigint").alias("max_depth"))
    counts = S.merged(stored("link_counts"), "site_id").select("site_id", *[F.col(f"n_{c}").alias(c) for c in COUNTS])
    maps = materialise(S.merged(stored("maps"), "site_id", "map_url", "method"), "maps")
    contact = S.merged(stored("contact_maps"), "site_id").select("site_id", F.col("n_contact").alias("contact_page_maps"))
    found = maps.select("site_id", "map_url").distinct()
    social = S.merged(stored("social"), "site_id", "platform").select("site_id", "platform", "min_at.profile")
    brand = S.merged(stored("brand"), "site_id").select("site_id", F.col("min_at.name").alias("ld_brand"))
    phones = first_values(stored("phones").withColumnRenamed("min_page", "page_id"), "phone", ["site_id", "kind"], 3)
    kinds = phones.groupBy("site_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("joined"))).alias(f"{k}_phone") for k in C.PHONE_KINDS])
    words = first_values(stored("keywords").withColumnRenamed("min_page", "page_id"), "keyword", ["site_id"], 20).withColumnRenamed("joined", "keywords")
    videos = materialise(S.merged(stored("videos"), "site_id", "video_url"), "videos")
    offers = S.merged(stored("offers"), "site_id", "url", "name").select("site_id", "url", "name", "min_offer.*")
    parts = {
        "text": S.text_finish(S.merged(stored("text"), "site_id"), as_of_year), "main": mains, "link_columns": S.side_by_side([structure, counts]),
        "maps": _map_counts(maps).join(contact, "site_id", "left"),
        "lists": S.side_by_side([C.social_columns(social), brand, kinds, words, S.video_columns(videos)]),
        "products": PR.product_columns(PR.price_extremes(offers)),
        "about": _about(stored, pages),
    }
    sites = S.side_by_side([materialise(df, name) for name, df in parts.items()]).where("pages_analysed is not null")
    done = S.finish(materialise(sites, "sites"), analysis_date)
    return S.with_lists(done, found, videos) if lists else done


def _map_counts(maps: DataFrame) -> DataFrame:
    """MP5, MP7 from counts by (site, link, method)."""
    def n(method: str):
        return F.sum(F.when(F.col("method") == method, F.col("n_found")).otherwise(0))

    per_url = maps.groupBy("site_id", "map_url").agg(n("direct").alias("d"), n("iframe").alias("i"), n("javascript").alias("j"), n("structured").alias("s"))
    first = F.min(F.struct(M.priority(F.col("map_url")).alias("p"), "map_url"))["map_url"]
    return per_url.groupBy("site_id").agg(
        F.sum("d").alias("direct_links"), F.sum("i").alias("iframe_embeds"), F.sum("j").alias("javascript_maps"), F.sum("s").alias("structured_data_maps"),
        F.count("*").alias("total_maps_found"), first.alias("primary_maps_link"), F.lit("Integrated").alias("maps_status"))


def _about(stored, pages: DataFrame | None) -> DataFrame:
    """MD2-MD5 from the states."""
    best = materialise(MD.longest_about(stored("about_pages"), stored("about_links").distinct()), "about_best")
    texts = best.join(stored("about_texts").withColumn("made", F.lit(True)), "page_id", "left")
    if pages is not None:
        late = materialise(texts.where("made is null").select("page_id"), "about_late")
        made = D.about_texts(D.parse(pages.select("page_id", "url", "html").join(late, "page_id", "left_semi"))).select("page_id", F.col("about_text").alias("late"))
        texts = texts.join(made, "page_id", "left").withColumn("about_text", F.coalesce("about_text", "late"))
    named = materialise(texts.where("about_text is not null").select("site_id", "about_text", F.col("url").alias("about_url")), "about_texts")
    sections = stored("about_sections").withColumn("site_id", U.site_of(F.col("url"))).join(named.select("site_id"), "site_id", "left_anti")
    return named.unionByName(MD.about_fallback(sections).withColumn("about_url", F.lit(None).cast("string")))
