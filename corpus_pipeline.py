"""From raw documents to packed windows: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. All stages take empty
tables, and leave columns but doc_id, text, source and n_chars as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.encoding import default_tokenizer
from lexiloom.llm.exact import exact_duplicates
from lexiloom.llm.mixing import mixed
from lexiloom.llm.near import near_duplicates
from lexiloom.llm.packing import pack
from lexiloom.llm.quality import score
from lexiloom.llm.store import dropped_since, marked, saved
from lexiloom.llm.text import only


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weigh as much as good ones do. Null and empty texts weigh 0, at or over the floors as a rule; repeated rows all stay or all go."""
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the least doc_id, null ids last; null and empty texts are one such group, repeated rows another."""
    return only(docs, saved(exact_duplicates(docs).where("kept").select("doc_id", "content")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more. Texts without words stay; of repeated rows one does."""
    return only(docs, saved(near_duplicates(docs, words=5, similarity=80).where("kept").select("doc_id", "content")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each copy that the mix takes, the last one cut where the quota ends. Texts without words are not taken; a null source is one of its own."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows: the pieces, with their ids, a null text having the end mark alone. Workers keep fewer words here, beside what earlier stages left in the executors."""
    return pack(docs, default_tokenizer(), max_words=150_000)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixing), ("packing", packing)]

#: No SQL expresses the classifier, the draws or the tokenizer: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables that a stage saved are deleted once its result is written, but for that result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = marked()
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        dropped_since(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
