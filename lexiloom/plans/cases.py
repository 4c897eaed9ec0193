"""Evaluation sets and the plans that run them over an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate, index, models, retrieve
from .config import Settings
from .ingest import ask

# The questions that results are compared by.

#: (question, expected content type, expected words)
RETRIEVAL_CASES = (
    ("Is GRE required for admission?", "faq", ("gre", "gmat", "not required")),
    ("What is the capstone project?", "capstone", ("capstone", "project", "real")),
    ("Is the online program synchronous or asynchronous?", None, ("synchronous", "asynchronous", "online")),
    ("What are the application deadlines?", None, ("deadline", "June 23, 2026", "Autumn 2026")),
    ("Is the in-person program STEM OPT eligible?", None, ("STEM", "OPT", "in-person")),
    ("How many courses are required?", None, ("12", "courses", "core", "elective")),
    ("What is the 2-year thesis track?", None, ("2-year", "thesis", "18")),
)
#: (question, expected words of the answer)
ANSWER_CASES = (
    ("Is GRE required?", "GRE not required"),
    ("What is the capstone project?", "capstone project real-world data science"),
    ("Is the online program synchronous or asynchronous?", "both synchronous and asynchronous"),
    ("Is the in-person program STEM OPT eligible?", "STEM OPT eligible"),
    ("Does the online program provide visa sponsorship?", "no visa sponsorship"),
)
#: (question, reference answer) for an external judge
JUDGED_CASES = (
    ("Is GRE required for admission?", "The GRE/GMAT is not required for admission, but applicants may submit scores if they choose."),
    ("What is the capstone project?", "The capstone project is a required applied project involving real-world data science problems."),
    ("Is the online program synchronous or asynchronous?", "The online program includes both synchronous and asynchronous components."),
    ("Is the in-person program STEM OPT eligible?", "The full-time in-person MS in Applied Data Science program is STEM/OPT eligible."),
    ("Does the online program provide visa sponsorship?", "The online program is not eligible for visa sponsorship."),
)
SMOKE_QUESTIONS = (
    "What is the capstone project?", "Is GRE required for admission?", "What are the application deadlines?",
    "Is the online program synchronous or asynchronous?", "Is the in-person program STEM OPT eligible?", "What is the 2-year thesis track?",
    "What scholarships are available?", "Does the online program provide visa sponsorship?",
)
SEARCH_QUERIES = (
    "What is the capstone project?", "Is GRE required for admission?", "What are the application deadlines?",
    "Is the online program synchronous or asynchronous?", "How many courses are required?", "Is the in-person program STEM OPT eligible?",
    "What is the 2-year thesis track?", "Who teaches machine learning?",
)


def questions(spark: SparkSession, asked: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")


def evaluate_retrieval(records: DataFrame, k: int = 5, cases: tuple = RETRIEVAL_CASES, **models) -> DataFrame:
    """One row for each case: type_hit, keyword_hit, success. ``evaluate.accuracy`` sums them up."""
    spark = records.sparkSession
    asked = index.embed(questions(spark, tuple(c[0] for c in cases)), "question", **models).select("query_id", "embedding")
    expected = [(k, kind, list(words) if words else None) for k, (_, kind, words) in enumerate(cases)]
    expected = spark.createDataFrame(expected, "query_id long, expected_content_type string, expected_keywords array<string>")
    return evaluate.hit_rate(expected, retrieve.search(records, asked, k))


def evaluate_answers(records: DataFrame, settings: Settings = Settings(), cases: tuple = ANSWER_CASES, **models) -> DataFrame:
    """correctness, groundedness, retrieval and final_score for each case."""
    spark = records.sparkSession
    answers = ask(records, questions(spark, tuple(c[0] for c in cases)), settings, **models)
    return evaluate.score_answers(answers, spark.createDataFrame([(k, c[1]) for k, c in enumerate(cases)], "query_id long, expected string"))


def judged_set(records: DataFrame, settings: Settings = Settings(), cases: tuple = JUDGED_CASES, **models) -> DataFrame:
    """(question, answer, contexts, reference): what an external judge is given, to be written with ``files.write_csv`` or as JSON."""
    spark = records.sparkSession
    answers = ask(records, questions(spark, tuple(c[0] for c in cases)), settings, **models)
    return evaluate.judged_set(answers, spark.createDataFrame([(k, c[1]) for k, c in enumerate(cases)], "query_id long, reference string"))


def evaluate_judged(records: DataFrame, settings: Settings = Settings(), judge: Callable[[], models.Judge] = models.SharedWordsJudge, **options) -> DataFrame:
    """The judged set with the judge's three scores, to be written with ``files.write_csv`` once ``contexts`` is dropped or joined."""
    return evaluate.judged_scores(judged_set(records, settings, **options), judge)
