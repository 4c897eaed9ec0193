"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed size. Sorting the distinct blocks gives each an integer name;
then adjacent pairs of names are sorted and named in turn, until each document has one name. Two
documents share an identity exactly when their normalised texts are equal: names are never
compared by fingerprint alone.

Text is shuffled once. Blocks are sorted by a 64-bit fingerprint with the smallest and the largest
block of each fingerprint as partial aggregates, so copies meet in the map tasks; where the two are
equal, that fingerprint stands for one block and only integers move from then on. A fingerprint
with several blocks is resolved by sorting the blocks themselves (``_disputed``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import text as X
from .store import dropped, saved

BLOCK = 2048
_LONE = -(2**63)  # the missing right half of a pair: no name has this value


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names for distinct keys, in their sort order."""
    return distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, rows: DataFrame, block: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(row, n, pos, name) for each block of each row."""
    cut = docs.select(F.explode(X.blocks(X.one_spaced(F.col("text")), block)).alias("block"))
    marks = cut.select("block", fingerprint(F.col("block")).alias("h")).groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    names = saved(_named(marks.select("h", (F.col("lo") == F.col("hi")).alias("single")), "h"))
    at = rows.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    out = at.join(names.where("single").select("h", "name"), "h").select("row", "n", "pos", "name")
    disputed = names.where("NOT single")
    if disputed.isEmpty():
        return out
    return out.unionByName(_disputed(docs, rows, at, disputed, block, fingerprint))


def _disputed(docs: DataFrame, rows: DataFrame, at: DataFrame, disputed: DataFrame, block: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Names for the blocks whose fingerprint another block shares: negative, by sorting the blocks.

    About n^2 / 2^65 of n distinct blocks come here: none, or a handful at any real size.
    """
    spaced = X.one_spaced(F.col("text"))
    texts = docs.select(F.struct("doc_id", F.sha2(spaced, 256)).alias("of"), spaced.alias("text")).distinct()
    own = at.join(disputed.select("h"), "h", "left_semi").select("row").distinct()
    own = rows.join(own, "row", "left_semi").select("row", F.struct("doc_id", "text_sha256").alias("of"))
    texts = own.join(texts, own["of"].eqNullSafe(texts["of"])).select("row", texts["text"])
    cut = texts.select("row", F.posexplode(X.blocks(F.col("text"), block)).alias("pos", "block")).withColumn("h", fingerprint(F.col("block")))
    cut = saved(cut.join(disputed.select("h"), "h", "left_semi"))
    names = saved(_named(cut.select("h", "block").distinct(), "h", "block"))
    own = cut.join(names, ["h", "block"]).select("row", "pos", (-1 - F.col("name")).alias("name"))
    return at.select("row", "n", "pos").join(own, ["row", "pos"]).select("row", "n", "pos", "name")


def identities(docs: DataFrame, *, block: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, content, text_sha256, level, name) for each row of ``docs`` (doc_id, text).

    Rows with equal (level, name), and only those, have equal normalised texts. ``level`` counts the
    pairings that it took. ``row`` tells repeated rows apart; ``content`` is a hash of the text as it
    is, for :func:`lexiloom.llm.text.only`. A null text counts as empty.
    """
    docs = docs.select("doc_id", "text")
    spaced = X.one_spaced(F.col("text"))
    marked = docs.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.xxhash64("text").alias("content"), F.sha2(spaced, 256).alias("text_sha256"), F.transform(X.blocks(spaced, block), lambda b: fingerprint(b)).alias("hs")
    )
    rows = saved(marked)
    names = saved(_first_names(docs, rows, block, fingerprint))
    ends = [names.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    level = 0
    while not (rest := names.where("n > 1")).isEmpty():
        level += 1
        half = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = saved(
            rest.groupBy("row", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(half[0]).alias("a"), F.coalesce(F.max(half[1]), F.lit(_LONE)).alias("b")
            )
        )
        own = saved(_named(pairs.select("a", "b").distinct(), "a", "b"))
        names = saved(pairs.join(own, ["a", "b"]).select("row", "n", "pos", "name"))
        dropped(pairs, own)
        ends.append(names.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    named = ends[0]
    for end in ends[1:]:
        named = named.unionByName(end)
    return rows.select("row", "doc_id", "content", "text_sha256").join(named, "row")


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id, content, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays, a null doc_id being the largest; of repeated
    rows with that doc_id just one stays. A null text counts as empty; an empty table gives an empty
    result. Other columns are neither read nor returned.
    """
    named = saved(identities(docs, **options))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = saved(named.groupBy("level", "name").agg(first, F.count("*").alias("group_size")).where("group_size > 1"))
    out = named.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "row", "doc_id", "content",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
