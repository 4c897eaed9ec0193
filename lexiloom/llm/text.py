"""Expressions over texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def whole(text: Column) -> Column:
    """The text, a null text counting as empty."""
    return F.coalesce(text, F.lit(""))


def one_spaced(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(whole(text), rf"[{SPACE}]+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def blocks(text: Column, size: int) -> Column:
    """The text cut into blocks of ``size`` code points in one pass; an empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def running(lengths: Column, step: int = 512, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """array<int>: for each of ``lengths``, the sum of those before it, or what else ``add`` makes of them, from 0 on.

    Sums are made within runs of ``step`` items, then over the runs, so no long array is copied once for each item.
    """
    ints = F.expr("cast(array() AS array<int>)")

    def sums(part: Column) -> Column:
        begin = F.struct(F.lit(0).alias("total"), ints.alias("before"))
        return F.aggregate(part, begin, lambda s, n: F.struct(add(s["total"], n).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda k: sums(F.slice(x, k * step + 1, step)))
        whole = lambda r: F.zip_with(r, sums(F.transform(r, lambda y: y["total"]))["before"], lambda y, t: F.transform(y["before"], lambda b: add(b, t)))
        return F.when(F.size(x) > 0, F.flatten(let(runs, whole))).otherwise(ints)

    return let(lengths, of)


def substrings(text: Column, places: Column, make: Callable[[Column], Column], block: int = 4096) -> Column:
    """``make`` of what the text holds at each of ``places`` (array<struct<start, end>>, code points, end exclusive).

    The text is cut into blocks once: a substring of a long text would look for its start from the text's beginning.
    """

    def of(cut: Column) -> Column:
        first = lambda p: F.floor(p["start"] / block).cast("int")
        some = lambda p: F.array_join(F.slice(cut, first(p) + 1, F.floor(p["end"] / block).cast("int") - first(p) + 1), "")
        return F.transform(places, lambda p: make(F.substr(some(p), p["start"] - first(p) * block + 1, p["end"] - p["start"])))

    return let(blocks(text, block), of)


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with each of ``spans`` (array<struct<start, end, ...>>, by start) replaced by its ``mask``; of spans that overlap the first one's.

    What lies between spans is cut out of blocks and joined once: no state grows with the text.
    """
    gap = lambda start, end, put: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.coalesce(put, F.lit("")).alias("mask"))

    def of(all_: Column) -> Column:
        ends = F.transform(all_, lambda x: x["end"].cast("int"))
        before = F.zip_with(all_, running(ends, add=F.greatest), lambda x, reached: gap(reached, x["start"], mask(x)))
        gaps = F.concat(F.filter(before, lambda g: g["start"] <= g["end"]), F.array(gap(F.array_max(ends), F.length(text), F.lit(""))))
        put = lambda g: F.array_join(F.zip_with(substrings(text, g, lambda c: c), g, lambda c, x: F.concat(c, x["mask"])), "")
        return let(gaps, put)

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(text)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by (doc_id, content), content being the hash of the text; of repeated rows one.

    Of rows of one id and text that differ elsewhere the least stays, its other columns compared in their order (maps aside). All columns stay as they are. Null ids match each other. ``kept`` grows with the input and is never broadcast.
    """
    named = lambda doc_id, content: [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_id"), doc_id.isNull().alias("_no"), content.alias("_content")]
    keys = ["_id", "_no", "_content"]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *named(F.col("doc_id"), F.xxhash64("text")))
    wanted = kept.select(*named(F.col("doc_id"), F.col("content"))).distinct()
    order = [F.col("doc")[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    least = F.min_by("doc", F.struct(F.lit(0), *order)).alias("doc")
    return rows.join(wanted.hint("merge"), keys, "left_semi").groupBy(*keys).agg(least).select("doc.*")
