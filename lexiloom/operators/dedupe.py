"""Duplicates, first one stays, in an order that is given explicitly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group, by a window: for groups that are small by their nature, and any order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def keep_first_slim(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """As :func:`keep_first`, by a partial aggregate: ``df`` is read once, and a group of any size is one row for each map task.

    ``order`` are columns, ascending, null first, that tell rows apart.
    """
    key = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)))
    rest = [c for c in df.columns if c not in order]
    # The least struct has the least order; what follows in it only travels along.
    row = F.struct(*(F.col(c) for c in order), F.struct(*rest).alias("_rest")) if rest else F.struct(*order)
    first = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_first"))
    return first.select(*((F.col("_first")[c] if c in order else F.col("_first")["_rest"][c]).alias(c) for c in df.columns))


def content_fingerprint(content: Column | str) -> Column:
    return T.sha256(F.lower(T.clean_text(content)))


def dedupe_sections(sections: DataFrame, order: Sequence[str] = ("page_seq", "section_seq"), contiguous: bool = True) -> DataFrame:
    """Sections without repeats of one address, by address and content.

    With each address's sections in one run, which a crawl gives, this is the first of each address
    and content. ``contiguous=False`` takes any order: a section goes if its (address, title, content)
    was kept before, or if its address is that of the last section kept with its content. ``order`` must tell sections apart.
    """
    near = content_fingerprint("content")
    if contiguous:
        return keep_first_slim(sections, [F.col("url"), near], order)
    return _dedupe_any_order(sections, near, list(order))


def _dedupe_any_order(sections: DataFrame, near: Column, order: list[str]) -> DataFrame:
    """Sections are kept that begin a run of one address among the live ones of their content; one is live whose key no earlier kept one has.

    Who is live follows from who is kept and the other way round, so both are worked out in rounds until nothing changes. After each
    round one more of a content's sections, from the first on, is settled at the least; it takes two rounds, and one more wherever a repeated
    key hides a change of address. Rounds are of addresses and hashes, not of texts, and are checkpointed in the session's folder.
    """
    key = T.sha256(F.lower(F.concat_ws("|", "url", "section_title", F.coalesce(F.nullif("content_clean", F.lit("")), "content"))))
    slim = sections.select(near.alias("near"), F.struct(*order).alias("place"), "url", key.alias("key"))
    # Ranges of (content, place), so that the sections of one content may be in many tasks.
    rows = slim.repartitionByRange("near", "place").withColumns({"part": F.spark_partition_id(), "gone": F.lit(False)}).checkpoint()
    while True:
        live = rows.where("NOT gone")
        in_part = Window.partitionBy("part").orderBy("near", "place")
        last = live.groupBy("part").agg(F.max_by(F.struct("near", "url"), F.struct("near", "place")).alias("_last"))
        # One row for each range: what the ranges before it end with.
        border = last.select("part", F.lag("_last").over(Window.orderBy("part")).alias("_border"))
        before = live.withColumns({"_before": F.lag(F.struct("near", "url")).over(in_part), "_nth": F.row_number().over(in_part)}).join(F.broadcast(border), "part")
        before = before.withColumn("_before", F.when(F.col("_nth") == 1, F.col("_border")).otherwise(F.col("_before")))
        heads = before.where(~F.coalesce(F.col("_before") == F.struct("near", "url"), F.lit(False))).select("near", "place", "key")
        first = heads.groupBy("near", "key").agg(F.min("place").alias("_kept"))
        told = rows.join(first, ["near", "key"], "left").withColumn("_gone", F.coalesce(F.col("place") > F.col("_kept"), F.lit(False)))
        told = told.select(*rows.columns, "_gone", (F.col("place") == F.col("_kept")).alias("kept")).checkpoint()
        if told.where("gone <> _gone").isEmpty():
            break
        rows = told.withColumn("gone", F.col("_gone")).select(*rows.columns)
    kept = told.where("kept").select(F.col("place").alias("_order"))
    return sections.withColumn("_order", F.struct(*order)).join(kept, "_order", "left_semi").drop("_order")


def with_duplicate_of(sections: DataFrame, order: Sequence[str] = ("page_seq", "section_seq")) -> DataFrame:
    """Every section with the doc_id that it repeats, null for the first: a view to audit what goes.

    The first of each group is found by a partial aggregate of keys; texts meet it in a join, which adaptive execution can split.
    """
    rows = sections.drop("duplicate_of").withColumns({"_near": content_fingerprint("content"), "_place": F.struct(*order)})
    first = rows.groupBy(F.col("url").alias("_url"), F.col("_near").alias("_content")).agg(F.min(F.struct("_place", "doc_id")).alias("_first"))
    out = rows.join(first, F.col("url").eqNullSafe(F.col("_url")) & (F.col("_near") == F.col("_content")))
    repeats = F.when(F.col("_place") != F.col("_first._place"), F.col("_first.doc_id"))
    return out.withColumn("duplicate_of", repeats).drop("_near", "_place", "_url", "_content", "_first")


def dedupe_chunks(chunks: DataFrame, order: Sequence[str] = ("page_seq", "section_seq", "chunk_index")) -> DataFrame:
    """The first chunk of each content, whatever its address. Chunk numbers stay as they are."""
    content = F.coalesce(F.nullif("content_clean", F.lit("")), F.col("content"))
    return keep_first_slim(chunks, [content_fingerprint(content)], order)


def dedupe_hits(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """The best hit for each query, address and section; a missing address or section counts as empty."""
    keys = [F.col(query), F.coalesce("url", F.lit("")), F.coalesce("section_title", F.lit(""))]
    return keep_first(hits, keys, [F.desc_nulls_last("score"), F.col("id")])
