"""spark-submit lexiloom/cli.py ingest|index|ask|search|peek|chat ...: a thin command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom import chat
from lexiloom.operators import embedder, generate, index, inverted, lexical, models, retrieve
from lexiloom.operators.crawl import crawl
from lexiloom.plans.config import Settings
from lexiloom.plans.ingest import ask, run_ingest
from lexiloom.sources import files, vectors, web


def _lines() -> Iterator[str]:
    for line in sys.stdin:
        if (text := line.strip()).lower() in ("exit", "quit", "q"):
            return
        if text:
            yield text


def _questions(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "query_id long, question string")


def records(spark: SparkSession, settings: Settings) -> DataFrame:
    """The records of the index as they are now; an error that names the step that makes them, if there are none."""
    found = vectors.read(spark, settings.index_dir)
    if found is None:
        raise FileNotFoundError(f"no index in {settings.index_dir}: run the step index first")
    return found


def nearest(spark: SparkSession, settings: Settings) -> Callable[[DataFrame, int], DataFrame]:
    """Search by the lists that the step index has built."""
    file = inverted.opened(spark, f"{settings.index_dir}/lists")
    return lambda queries, k: inverted.search(file, queries, k)


def embeds(spark: SparkSession, settings: Settings, learn_from: DataFrame | None = None) -> Callable[[], models.Embedder]:
    """The index's embedder: the one that was learnt for it, or the substitute. With records to ``learn_from``, learnt from their documents if there is none.

    An index holds vectors of one embedder: what was learnt stays, and an index made without can't be given one.
    """
    at = f"{settings.index_dir}/words"
    if vectors.exists(f"{at}/_SUCCESS"):
        return embedder.read(spark, at).model()
    if learn_from is None:
        return models.HashedWords
    if vectors.read(spark, settings.index_dir) is not None:
        raise ValueError(f"the index in {settings.index_dir} has vectors of another embedder: learn for a new one")
    learnt = embedder.learn(learn_from, "document")
    learnt.write(at)  # before any vector: a run that was broken off between is taken up here
    return learnt.model()


def _checkpoints(spark: SparkSession, settings: Settings) -> None:
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or f"{settings.output_dir}/.checkpoints")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=("ingest", "index", "count", "peek", "search", "ask", "chat"))
    parser.add_argument("--content-type")
    parser.add_argument("--program-type")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--by-words", action="store_true", help="ask: rerank by BM25 and answer in sentences of the sources")
    parser.add_argument("--learnt", action="store_true", help="index: learn the embedder from the chunks, for a new index")
    parser.add_argument("--port", type=int, default=8501)
    given = parser.parse_args(args)
    settings, spark = Settings.from_env(), SparkSession.builder.appName("lexiloom").getOrCreate()
    chunks = f"{settings.output_dir}/chunks.jsonl"
    if given.step == "ingest":
        _checkpoints(spark, settings)
        fetch = web.fetcher(timeout=settings.request_timeout_seconds, attempts=settings.max_retries)
        print(run_ingest(crawl(spark, settings.seed_urls, fetch, max_pages=settings.max_pages), settings))
    elif given.step == "index":
        _checkpoints(spark, settings)
        read = files.read_jsonl(spark, chunks)
        model = embeds(spark, settings, index.index_records(read) if given.learnt else None)
        vectors.put(index.build_index(read, model), settings.index_dir)
        inverted.build(records(spark, settings), f"{settings.index_dir}/lists")
    elif given.step == "count":
        print(vectors.count(spark, settings.index_dir))
    elif given.step == "peek":
        files.peek(files.read_jsonl(spark, chunks)).show(truncate=False)
    elif given.step == "chat":
        chat.server(chat.answerer(records(spark, settings).cache(), settings, nearest=nearest(spark, settings), embedder=embeds(spark, settings)), given.port).serve_forever()
    else:
        known, lists, model = records(spark, settings).cache(), nearest(spark, settings), embeds(spark, settings)
        corpus = lexical.corpus(known, "document") if given.by_words else None
        for line in _lines():
            questions = _questions(spark, [line])
            if given.step == "search":
                asked = index.embed(questions, "question", model=model).select("query_id", "embedding")
                found = retrieve.search(known, asked, given.top_k, given.content_type, given.program_type, lists)
                found.select("rank", F.round(1 - F.col("distance"), 4).alias("similarity"), "metadata.section_title", F.substring("document", 1, 1400).alias("document")).orderBy("rank").show(truncate=False)
            else:
                out = ask(known, questions, settings, embedder=model, nearest=lists, content_type=given.content_type, program_type=given.program_type, corpus=corpus)
                row = out.select("answer", generate.source_lines(F.col("sources")).alias("lines")).first()
                print(row.answer, row.lines, sep="\n")


if __name__ == "__main__":
    main()
