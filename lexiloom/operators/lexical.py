"""Words weighed by the corpus: BM25 as a reranker, answers drawn from the hits' sentences. Frames and expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: How soon repeats of a word stop to count, and how much a document's length does.
SATURATION, LENGTH = 1.2, 0.75
#: Digits that are kept of a sum: what follows hangs on the order in which tasks add.
DIGITS = 9


def words(text: Column | str) -> Column:
    """The words of a text in lower case, in their order, repeats included; none of a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{Nd}\p{Pc}]+)"), F.lit(1))


@dataclass(frozen=True)
class Corpus:
    """What is known of a corpus: ``frequencies`` (word, n), n being the documents with the word, and ``size``, one row (documents, mean_words)."""

    frequencies: DataFrame
    size: DataFrame


def corpus(documents: DataFrame, text: str = "text") -> Corpus:
    """Statistics of all documents. Words are counted once a document and combined in map tasks; an empty text is a document."""
    listed = documents.select(words(text).alias("words"))
    frequencies = listed.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return Corpus(frequencies, listed.agg(F.count("*").alias("documents"), F.avg(F.size("words")).alias("mean_words")))


def question_weights(questions: DataFrame, of: Corpus) -> DataFrame:
    """(query_id, word, weight) for ``questions`` (query_id, question): each word once, the rarer the heavier; one that no document has weighs most."""
    asked = questions.select("query_id", F.explode(F.array_distinct(words("question"))).alias("word")).distinct()
    n, documents = F.coalesce("n", F.lit(0)), of.size.select("documents").scalar()
    known = asked.join(of.frequencies, "word", "left").withColumn("_documents", documents)
    return known.select("query_id", "word", F.log1p((F.col("_documents") - n + 0.5) / (n + 0.5)).alias("weight"))


def _matches(rows: DataFrame, keys: Sequence[str], listed: Column, weights: DataFrame) -> DataFrame:
    """(keys, word, weight, times) for the words of each row that its question has; ``keys`` tell rows apart and begin with query_id.

    Words that the question lacks go before anything is grouped.
    """
    told = rows.select(*keys, F.explode(listed).alias("word")).join(weights, ["query_id", "word"])
    return told.groupBy(*keys, "word").agg(F.first("weight").alias("weight"), F.count("*").alias("times"))


def bm25(hits: DataFrame, of: Corpus, saturation: float = SATURATION, length: float = LENGTH) -> DataFrame:
    """``hits`` (query_id, id, question, document, ...) with ``rerank_score``: BM25 of the document for its question, 0 where they share no word.

    Hits of one question must differ in their id. Null questions and documents have no words. Hits are read three times: where they are
    dear to find, write or checkpoint them first.
    """
    weights = question_weights(hits.select("query_id", "question"), of)
    slim = hits.select("query_id", "id", words("document").alias("_words"))
    sized = slim.select("query_id", "id", F.size("_words").alias("_long"), "_words")
    found = _matches(sized, ["query_id", "id", "_long"], F.col("_words"), weights).withColumn("_mean", of.size.select("mean_words").scalar())
    damp = saturation * (1 - length + length * F.col("_long") / F.col("_mean"))
    each = F.col("weight") * F.col("times") * (saturation + 1) / (F.col("times") + damp)
    scores = found.groupBy("query_id", "id").agg(F.round(F.sum(each), DIGITS).alias("rerank_score"))
    return hits.drop("rerank_score").join(scores, ["query_id", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def overlap(a: Column, b: Column) -> Column:
    """The words that two sets share, as a share of all that they hold."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def relevant_sentences(final: DataFrame, of: Corpus, most: int) -> DataFrame:
    """(query_id, rank, place, sentence, words, relevance): the ``most`` best sentences of each question's hits.

    Relevance is the weight of the question's words that the sentence has, as a share of the question's; sentences without any are left out.
    """
    weights = question_weights(final.select("query_id", "question"), of)
    whole = weights.groupBy("query_id").agg(F.sum("weight").alias("_whole"))
    lines = final.select("query_id", "rank", F.posexplode(T.split_sentences(T.clean_text("document"))).alias("place", "sentence"))
    lines = lines.withColumn("words", F.array_distinct(words("sentence")))
    keys = ["query_id", "rank", "place"]
    shared = _matches(lines, keys, F.col("words"), weights).groupBy(*keys).agg(F.sum("weight").alias("_shared"))
    shared = shared.join(whole, "query_id").withColumn("relevance", F.round(F.col("_shared") / F.col("_whole"), DIGITS))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank", "place"))
    best = shared.withColumn("_nth", nth).where((F.col("_nth") <= most) & (F.col("relevance") > 0)).select(*keys, "relevance")
    return lines.join(best, keys)


def extractive_answers(final: DataFrame, of: Corpus, sentences: int = 3, most: int = 20, balance: float = 0.7) -> DataFrame:
    """(query_id, said): an answer made of the hits' sentences, each with its source, by maximal marginal relevance.

    ``final`` is (query_id, question, rank, document), as after reranking. Of the ``most`` relevant sentences one is taken after the
    other, each time that with the greatest ``balance`` * relevance - (1 - balance) * overlap with what is taken that it resembles most; ties by rank and place.
    Questions of whose words no hit has any aren't listed.
    """
    one = F.struct("rank", "place", "sentence", "words", "relevance")
    pool = relevant_sentences(final, of, most).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("pool"))
    kind = pool.schema["pool"].dataType.simpleString()

    def step(taken: Column, _: Column) -> Column:
        def worth(c: Column) -> Column:
            near = F.coalesce(F.array_max(F.transform(taken, lambda t: overlap(c["words"], t["words"]))), F.lit(0.0))
            return F.round(balance * c["relevance"] - (1 - balance) * near, DIGITS)

        left = F.filter("pool", lambda c: ~F.exists(taken, lambda t: (t["rank"] == c["rank"]) & (t["place"] == c["place"])))
        best = F.array_min(F.transform(left, lambda c: F.struct((-worth(c)).alias("order"), c.alias("it"))))["it"]
        return F.when(best.isNull(), taken).otherwise(F.concat(taken, F.array(best)))

    taken = F.aggregate(F.sequence(F.lit(1), F.lit(sentences)), F.expr(f"cast(array() AS {kind})"), step)
    cited = F.transform(taken, lambda t: F.concat(t["sentence"], F.lit(" [Source "), t["rank"].cast("string"), F.lit("]")))
    return pool.select("query_id", F.array_join(cited, " ").alias("said"))
