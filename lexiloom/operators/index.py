"""The vector index: records (id, document, embedding, metadata) as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text as T
from .models import EMBEDDING_PREFIX, Embedder, HashedWords


def document_text() -> Column:
    """What is embedded of a record: its labels, then its text."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")))
    text = F.coalesce(F.nullif("content_clean", F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    heads = [part("Page title", "page_title"), part("Section title", "section_title"), part("Content type", "content_type"), part("Program type", "program_type")]
    return T.clean_text(F.concat_ws("\n", *heads, F.lit(""), text))


def metadata(columns: list[str]) -> Column:
    """A struct of scalars, lists joined by commas; empty lists and what the table lacks are null."""
    scalars = [F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in rules.METADATA_SCALARS]
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).alias(c)
    lists = [joined(c) if c in columns else F.lit(None).cast("string").alias(c) for c in rules.METADATA_LISTS]
    return F.struct(*scalars, *lists)


def index_records(chunks: DataFrame, shortest: int = 40) -> DataFrame:
    """(id, document, metadata) of the chunks that have an id and some text."""
    named = F.coalesce(F.nullif("chunk_id", F.lit("")), F.nullif("doc_id", F.lit("")))
    # Exploded: conditions on a projected text would work it out anew, each for itself.
    long_enough = F.filter(F.array(document_text()), lambda d: F.length(d) >= shortest)
    return chunks.where(named.isNotNull()).select(named.alias("id"), F.explode(long_enough).alias("document"), metadata(chunks.columns).alias("metadata"))


def embed(df: DataFrame, text: str, into: str = "embedding", model: Callable[[], Embedder] = HashedWords, batch: int = 32) -> DataFrame:
    """``df`` with the embedding of a text column; rows without text go, as they have none.

    ``model`` is called once in each task, so a model is loaded where it is used.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model()
        for part in parts:
            texts = [EMBEDDING_PREFIX + t.strip() for t in part]
            rows = [r for at in range(0, len(texts), batch) for r in made.embed(texts[at : at + batch])]
            yield pd.Series(rows, dtype=object)

    return df.where(T.not_blank(text)).withColumn(into, run(text))


def build_index(chunks: DataFrame, model: Callable[[], Embedder] = HashedWords) -> DataFrame:
    return embed(index_records(chunks), "document", model=model).select("id", "document", "embedding", "metadata")


def upsert(index: DataFrame, records: DataFrame, version: str | None = None) -> DataFrame:
    """The index with ``records`` put in by id; of several records with one id the last wins.

    The last is that of the largest ``version``, or, without such a column, that which comes last in ``records``. Old
    records are passed by an anti-join; of new ones a group is one row for each map task.
    """
    last = records.withColumn("_at", F.monotonically_increasing_id() if version is None else F.col(version))
    columns = [c for c in records.columns if c != version]
    last = last.groupBy("id").agg(F.max_by(F.struct(*columns), "_at").alias("_last")).select(*(F.col("_last")[c].alias(c) for c in columns))
    return index.join(last.select("id"), "id", "left_anti").unionByName(last)
