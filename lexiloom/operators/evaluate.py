"""Evaluation of retrieval and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .lexical import words
from .models import Judge, SharedWordsJudge

#: The share of a sentence's words that a sentence which bears it out must have.
SUPPORT = 0.5


def hit_rate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each of ``cases`` (query_id, expected_content_type, expected_keywords): type_hit, keyword_hit, success.

    A case succeeds if it has hits, one of them of the type asked for, and any of the words asked
    for occurs in the hits' documents or metadata. What isn't asked for is met.
    """
    values = F.lower(F.concat_ws(" ", "document", *(F.col(f"metadata.{f.name}").cast("string") for f in hits.schema["metadata"].dataType.fields)))
    slim = hits.select("query_id", F.col("metadata.content_type").alias("kind"), values.alias("blob"))
    asked = cases.join(slim, "query_id", "left")
    word = F.exists("expected_keywords", lambda w: F.col("blob").contains(F.lower(w)))
    out = asked.groupBy("query_id").agg(
        F.max(F.col("blob").isNotNull()).alias("any_hit"),
        F.max(F.coalesce(F.col("expected_content_type").isNull() | (F.col("kind") == F.col("expected_content_type")), F.lit(False))).alias("type_hit"),
        F.max(F.coalesce((F.size("expected_keywords") <= 0) | F.col("expected_keywords").isNull() | word, F.lit(False))).alias("keyword_hit"),
    )
    return out.withColumn("success", F.col("any_hit") & F.col("type_hit") & F.col("keyword_hit"))


def accuracy(results: DataFrame) -> DataFrame:
    return results.agg(F.sum(F.col("success").cast("int")).alias("passed"), F.count("*").alias("total"), F.avg(F.col("success").cast("double")).alias("accuracy"))


def correctness(answer: Column | str, expected: Column | str) -> Column:
    """The share of the expected words that occur in the answer."""
    answer, expected = (F.col(c) if isinstance(c, str) else c for c in (answer, expected))
    words = F.filter(F.split(F.lower(expected), r"(?U)\s+"), lambda w: w != "")
    return F.size(F.filter(words, lambda w: F.lower(answer).contains(w))) / F.size(words)


def groundedness(answer: Column | str) -> Column:
    return F.when((F.col(answer) if isinstance(answer, str) else answer).contains("[Source"), 1.0).otherwise(0.0)


def retrieval_score(chunks: Column | str) -> Column:
    """The mean of the hits' rerank scores, or scores where that is missing or 0; 0 without hits."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    each = F.transform(chunks, lambda c: F.coalesce(F.nullif(c["rerank_score"], F.lit(0.0)), F.nullif(c["score"], F.lit(0.0)), F.lit(0.0)))
    return F.when(F.size(chunks) > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(chunks)).otherwise(0.0)


def final_score(correct: Column, grounded: Column, retrieval: Column) -> Column:
    return 0.5 * correct + 0.2 * grounded + 0.3 * retrieval


def score_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Scores for ``answers`` (query_id, answer, retrieved) against ``expected`` (query_id, expected)."""
    out = answers.join(expected, "query_id").select("query_id", correctness("answer", "expected").alias("correctness"), groundedness("answer").alias("groundedness"), retrieval_score("retrieved").alias("retrieval"))
    return out.withColumn("final_score", final_score(F.col("correctness"), F.col("groundedness"), F.col("retrieval")))


def judged_set(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(question, answer, contexts, reference) for an external judge: contexts are the documents that aren't empty."""
    documents = F.filter(F.transform("retrieved", lambda c: c["document"]), lambda d: d.isNotNull() & (d != ""))
    return answers.join(references, "query_id").select("question", "answer", documents.alias("contexts"), "reference")


def judged_scores(judged: DataFrame, model: Callable[[], Judge] = SharedWordsJudge) -> DataFrame:
    """``judged`` (question, answer, contexts, reference) with faithfulness, response_relevancy and context_precision by a judge.

    Nulls count as empty. The judge is made once in each task.
    """

    @F.pandas_udf("faithfulness double, response_relevancy double, context_precision double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        made = model()
        for rows in parts:
            scores = [made.judge(q or "", a or "", [] if c is None else list(c), r or "") for q, a, c, r in zip(*rows, strict=True)]
            yield pd.DataFrame(scores, columns=["faithfulness", "response_relevancy", "context_precision"])

    return judged.withColumn("_scores", run("question", "answer", "contexts", "reference")).select(*judged.columns, "_scores.*")


def _sentences(text: Column) -> Column:
    """The sets of words of a text's sentences; a sentence without words is none."""
    return F.filter(F.transform(T.split_sentences(T.clean_text(text)), lambda s: F.array_distinct(words(s))), lambda s: F.size(s) > 0)


def _covered(sentence: Column, by: Column) -> Column:
    """The greatest share of a sentence's words that one of the sentences ``by`` has."""
    return F.coalesce(F.array_max(F.transform(by, lambda s: F.size(F.array_intersect(sentence, s)) / F.size(sentence))), F.lit(0.0))


def aligned_scores(judged: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``judged`` (question, answer, contexts, reference) with the three scores of a judge, by aligning sentences, in expressions alone.

    faithfulness: the share of the answer's sentences that a sentence of some context bears out, having ``support`` of its words.
    response_relevancy: the mean, over the question's sentences, of the greatest share of its words that a sentence of the answer has.
    context_precision: the mean share of good contexts down to each good one; one is good that bears out a sentence of the reference.
    Nulls count as empty; what has no sentence scores 0. A row's work is the product of its sentences and its contexts'.
    """
    sets = F.struct(
        *(_sentences(F.col(c)).alias(c) for c in ("question", "answer", "reference")),
        F.transform(F.coalesce("contexts", F.expr("cast(array() AS array<string>)")), _sentences).alias("contexts"),
    )
    share = lambda part, of: F.when(F.size(of) > 0, part / F.size(of)).otherwise(0.0)

    def scores(s: Column) -> Column:
        given = F.flatten(s["contexts"])
        borne = F.size(F.filter(s["answer"], lambda a: _covered(a, given) >= support))
        met = F.aggregate(F.transform(s["question"], lambda q: _covered(q, s["answer"])), F.lit(0.0), lambda x, y: x + y)
        good = F.transform(s["contexts"], lambda c: F.exists(s["reference"], lambda r: _covered(r, c) >= support))
        count = lambda flags: F.size(F.filter(flags, lambda g: g))
        down_to = lambda flags: F.transform(flags, lambda g, k: F.when(g, count(F.slice(flags, 1, k + 1)) / (k + 1)).otherwise(0.0))
        precision = T.let(good, lambda g: F.when(count(g) > 0, F.aggregate(down_to(g), F.lit(0.0), lambda x, y: x + y) / count(g)).otherwise(0.0))
        return F.struct(share(borne, s["answer"]).alias("faithfulness"), share(met, s["question"]).alias("response_relevancy"), precision.alias("context_precision"))

    return judged.withColumn("_scores", T.let(sets, scores)).select(*judged.columns, "_scores.*")
