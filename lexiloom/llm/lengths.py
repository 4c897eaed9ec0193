"""An exact histogram of encoded lengths that answers every context limit.

Tasks count the lengths of the documents that they scan; only (length, count) pairs are shuffled.
Suffix sums run in two levels, within spans of lengths and over the spans' totals, so no task holds
the whole histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SPAN = 512


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(length, n_docs) for ``docs`` (text): each encoded length that occurs.

    A null or empty text has length 0. Repeated rows count each. An empty table gives no row. Other columns are not read.
    """
    from .encoding import WordEncoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = WordEncoder.of(tokenizer), Counter()
        for batch in batches:
            found.update(len(ids) // 4 for ids in encoder.encoded(text.as_py() for text in batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["length", "n"])

    return docs.select("text").mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length, over the documents at least as long:

    docs_ge, tokens_ge; over all: docs_le (rank for quantiles) and truncated_tokens, the tokens that
    stay when each document is cut at this length. Documents of one length are one row of ``hist``, whose
    lengths must differ. An empty histogram stays empty; other columns are dropped.
    """
    hist = hist.withColumn("span", F.expr(f"length div {SPAN}"))
    totals = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    # One row for each span of lengths, as many at most as the longest document has spans: not a matter of how many documents there are.
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "span",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.coalesce(F.sum("d").over(below), F.lit(0)).alias("d_below"), F.coalesce(F.sum("t").over(below), F.lit(0)).alias("t_below"),
    )
    down = Window.partitionBy("span").orderBy(F.desc("length"))
    up = Window.partitionBy("span").orderBy("length")
    tokens = F.col("n_docs") * F.col("length")
    out = hist.join(totals, "span").select(
        "length", "n_docs",
        (F.col("d_above") + F.sum("n_docs").over(down)).alias("docs_ge"),
        (F.col("t_above") + F.sum(tokens).over(down)).alias("tokens_ge"),
        (F.col("d_below") + F.sum("n_docs").over(up)).alias("docs_le"),
        (F.col("t_below") + F.sum(tokens).over(up)).alias("t_le"),
    )
    cut = F.col("t_le") + F.col("length") * (F.col("docs_ge") - F.col("n_docs"))
    return out.select("length", "n_docs", "docs_ge", "tokens_ge", "docs_le", cut.alias("truncated_tokens"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, n_docs_over, total_tokens, truncated_tokens) for any limits, from the suffix sums."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = F.col("length") > F.col("context_limit")
    aggs = [
        F.coalesce(F.max(F.when(over, F.col("docs_ge"))), F.lit(0)).alias("n_docs_over"),
        F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.max(F.when(over, F.col("tokens_ge"))), F.lit(0)).alias("over"),
    ]
    # The limits are the caller's short list: each reads the histogram, not the documents.
    out = F.broadcast(asked).join(sums, F.lit(True), "left").groupBy("context_limit").agg(*aggs)
    kept = F.col("total_tokens") - F.col("over") + F.col("context_limit") * F.col("n_docs_over")
    return out.select("context_limit", "n_docs_over", "total_tokens", kept.alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length such that at least this share of the documents is no longer."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    total = sums.agg(F.max("docs_ge").alias("total"))
    reached = F.col("docs_le") >= F.col("share") * F.col("total")
    return sums.join(F.broadcast(total), F.lit(True)).join(F.broadcast(asked), reached).groupBy("share").agg(F.min("length").alias("length"))
