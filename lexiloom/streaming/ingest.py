"""Incremental ingest with Structured Streaming: an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import content_fingerprint


def new_chunks(chunks: DataFrame, event_time: str = "last_scraped_at", horizon: str = "7 days") -> DataFrame:
    """A stream of chunks without those whose content came before within the horizon. State is bounded by it."""
    content = F.coalesce(F.nullif("content_clean", F.lit("")), F.col("content"))
    return chunks.withColumn("fingerprint", content_fingerprint(content)).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def upsert_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep an index current: each micro-batch is written as it is under ``path``, by its number; nothing old is read or written again.

    :func:`current` reads the index, :func:`compact` folds batches into one. A batch that runs anew after a failure
    replaces its own files, so the result is exact.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_at", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The index under ``path``: of the records with one id the last, by ``version`` or else by batch and place in it."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    order = ([version] if version else []) + ["batch", "_at"]
    columns = [c for c in rows.columns if c not in ("batch", "_at")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return last.select(*(F.col("_last")[c].alias(c) for c in columns))


def compact(spark: SparkSession, path: str, into: str, version: str | None = None) -> None:
    """Write the index under ``path`` as the first batch under ``into``, from where streams may go on."""
    rows = current(spark, path, version).withColumn("_at", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(f"{into}/batch=-1")
