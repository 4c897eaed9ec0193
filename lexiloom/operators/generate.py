"""From hits to answers: numbered context, prompt, a model's answer, sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .models import FirstSource, Generator

#: The subject of the default instructions and refusal: a caller names the collection that is searched.
COLLECTION = "programme"

_INSTRUCTIONS = """You look things up for people in a set of {collection} pages.
Everything you state must come from the numbered sources in the message; put the number behind it, as in [Source 2].
Dates, sums of money and rules are only worth giving as the sources word them.
Where the sources leave the question open, reply with this sentence and nothing else: {refusal}
Keep it short."""

#: What stands before the context, before the question and at the end. The sources themselves are laid out by :func:`context_block`.
_ASK = "Sources found for the question at the end:\n\n"
_QUESTION = "\n\nQuestion: "
_WANTED = "\n\nAnswer from these sources, the main point first, each statement with its [Source n]:"


# Fixed value: the answer of a question without evidence, but for the name of the collection.
_REFUSAL = "I don't have enough information in the indexed {collection} sources to answer that."


def refusal(collection: str = COLLECTION) -> str:
    return _REFUSAL.format(collection=collection)


def instructions(collection: str = COLLECTION) -> str:
    return _INSTRUCTIONS.format(collection=collection, refusal=refusal(collection))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def context_block(number: Column, url: Column, page_title: Column, section_title: Column, content_type: Column, document: Column) -> Column:
    lines = [
        F.concat(F.lit("[Source "), number.cast("string"), F.lit("]")),
        F.concat(F.lit("URL: "), _or(url, "Unknown URL")),
        F.concat(F.lit("Page title: "), _or(page_title, "Unknown page")),
        F.concat(F.lit("Section title: "), _or(section_title, "Unknown section")),
        F.concat(F.lit("Content type: "), _or(content_type, "unknown")),
        F.lit(""),
        _or(document, ""),
    ]
    return F.regexp_replace(F.array_join(F.array(*lines), "\n"), r"(?U)\s+$", "")


def context_and_sources(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, context, sources, chunks): the hits of a question in rank order. Hits are few for each question."""
    m = lambda name: F.col(f"metadata.{name}")
    names = ("url", "page_title", "section_title", "content_type")
    one = F.struct("rank", "id", *(m(n).alias(n) for n in names), "score", "rerank_score", "document")
    sorted_hits = hits.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    block = lambda c, i: context_block(i + 1, c["url"], c["page_title"], c["section_title"], c["content_type"], c["document"])
    source = lambda c, i: F.struct(F.concat(F.lit("Source "), (i + 1).cast("string")).alias("source_id"), *(c[n].alias(n) for n in (*names, "score", "rerank_score")))
    return sorted_hits.select(query, F.array_join(F.transform("chunks", block), "\n\n").alias("context"), F.transform("chunks", source).alias("sources"), "chunks")


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(_ASK), context, F.lit(_QUESTION), question, F.lit(_WANTED))


def answer(
    questions: DataFrame, final: DataFrame, distinct: DataFrame, model: Callable[[], Generator] = FirstSource, collection: str = COLLECTION, said: DataFrame | None = None,
) -> DataFrame:
    """(query_id, question, answer, sources, retrieved): one row for each of ``questions`` (query_id, question).

    A question without a final hit is refused, with no source and the hits before the threshold.
    A failing model fails the job, its message kept. ``said`` (query_id, said) holds answers that are there already, as
    ``lexical.extractive_answers`` makes them, in place of a model's; a question that it lacks is refused.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model()
        for prompts in parts:
            asked = [p for p in prompts if p is not None]
            try:
                said = iter(made.generate([instructions(collection)] * len(asked), asked))
            except Exception as e:
                raise RuntimeError(f"the model gave no answer: {e}") from e
            yield pd.Series([None if p is None else next(said) for p in prompts], dtype=object)

    built = context_and_sources(final)
    seen = context_and_sources(distinct.withColumn("rerank_score", F.lit(None).cast("double"))).select("query_id", F.col("chunks").alias("seen"))
    out = questions.join(built, "query_id", "left").join(seen, "query_id", "left")
    if said is not None:
        out = out.join(said.select("query_id", "said"), "query_id", "left")
    else:
        out = out.withColumn("said", run(F.when(F.col("context").isNotNull(), prompt(F.col("context"), F.col("question")))))
    return out.select(
        "query_id", "question", F.coalesce("said", F.lit(refusal(collection))).alias("answer"),
        F.coalesce("sources", F.slice(F.array(F.lit(None).cast(built.schema["sources"].dataType.elementType)), 1, 0)).alias("sources"),
        F.coalesce("chunks", "seen").alias("retrieved"),
    )


def source_lines(sources: Column) -> Column:
    """``[id] section | type | address`` for each source."""
    return F.array_join(F.transform(sources, lambda s: F.format_string("[%s] %s | %s | %s", s["source_id"], s["section_title"], s["content_type"], s["url"])), "\n")
