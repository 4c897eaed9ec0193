"""Breadth-first crawl as a fixpoint over frames: a frontier, the pages seen, an anti-join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import rules, urls as U
from .sections import extract_links


def crawl(
    spark: SparkSession, seeds: Sequence[str] | DataFrame, fetch: Callable[[DataFrame], DataFrame], *, max_pages: int = 100,
    domains: tuple[str, ...] | None = rules.ALLOWED_DOMAINS, path_words: tuple[str, ...] = rules.ALLOWED_PATH_WORDS,
) -> DataFrame:
    """Pages in breadth-first order, with page_seq and depth, until nothing is new or ``max_pages`` were fetched.

    ``seeds`` are addresses, or a table of them (url, seq). ``fetch`` maps (url, seq) to pages (url, html, final_url, ...) of those that could be fetched:
    the rest stay visited, and don't count. Seeds needn't be allowed. A level of the crawl is one
    set of jobs, or several where pages fail while few are wanted: no more addresses are fetched at once than pages
    are still wanted. Order within a level is that of the parent pages and of links on them. Each level is cut off from
    its lineage by a checkpoint, in the session's checkpoint folder.
    """
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "url string, seq long")
    frontier = _first_of_each(seeds.select(U.canonicalize_url("url").alias("url"), F.col("seq").cast("long").alias("seq"))).checkpoint()
    visited = frontier.select("url")
    pages, n, depth = None, 0, 0
    while True:
        level, left = None, frontier
        while n < max_pages and (waiting := left.count()):
            some = left if waiting <= max_pages - n else left.orderBy("seq").limit(max_pages - n).checkpoint()
            got = fetch(some).checkpoint()
            level_part = _numbered(got, n).withColumn("depth", F.lit(depth)).checkpoint()
            n += level_part.count()
            level = level_part if level is None else level.unionByName(level_part)
            left = left.join(some.select("seq"), "seq", "left_anti").select("url", "seq").checkpoint()
        pages = level if pages is None else pages if level is None else pages.unionByName(level)
        if pages is None:
            return fetch(frontier.where("false")).withColumns({"depth": F.lit(depth), "page_seq": F.lit(0)}).drop("seq")
        if level is None or level.isEmpty() or n >= max_pages:
            return pages.drop("seq")
        at = level.withColumn("base", F.coalesce("final_url", "url")).select("html", "base", "page_seq")
        found = extract_links(at, "base", domains=domains, path_words=path_words)
        order = F.col("page_seq").cast("long") * 2**32 + F.col("link_seq")
        found = _first_of_each(found.select(U.canonicalize_url("link").alias("url"), order.alias("seq")))
        frontier = found.join(visited, "url", "left_anti").checkpoint()
        visited = visited.unionByName(frontier.select("url")).checkpoint()
        depth += 1


def _numbered(pages: DataFrame, first: int) -> DataFrame:
    """``pages`` with page_seq, from ``first`` on in the order of seq: places within sorted ranges, and what the ranges before hold."""
    placed = pages.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    held = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = held.select("_part", (F.lit(first) + before).alias("_first"))
    place = F.col("_first") + F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn("page_seq", place.cast("int")).drop("_at", "_part", "_first")


def _first_of_each(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("url").agg(F.min("seq").alias("seq"))


def fetch_from(pages: DataFrame, order: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` that looks addresses up in a table of pages (url, html): a crawl without a network.

    Of pages whose addresses are written alike once canonical, the first by ``order`` is found, or by its own address and text.
    """
    columns = pages.columns
    if "final_url" not in columns:
        pages = pages.withColumn("final_url", F.col("url"))
    of_url = pages.withColumn("_key", U.canonicalize_url("url"))
    row = F.struct(*([order] if order else []), "url", "html")
    first = of_url.groupBy("_key").agg(F.min_by(F.struct(*pages.columns), row).alias("_page"))
    first = first.select(F.col("_key").alias("url"), *(F.col("_page")[c].alias(c) for c in pages.columns if c != "url"))

    def fetch(frontier: DataFrame) -> DataFrame:
        return frontier.join(first, "url")

    return fetch
