"""Pages to chunks to index: the whole plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import chunk, dedupe, generate, index, lexical, models, retrieve, sections
from ..sources import files
from .config import Settings


def ingest(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pages`` (url, html, page_seq, ...) to distinct labelled chunks. One lazy plan: a Python stage, two shuffles."""
    found = sections.extract_sections(pages, settings.min_text_length)
    kept = dedupe.dedupe_sections(found)
    return dedupe.dedupe_chunks(chunk.chunk_sections(kept, settings.max_chunk_tokens, settings.overlap_sentences))


def run_ingest(pages: DataFrame, settings: Settings = Settings()) -> str:
    """Ingest and write the chunks and the FAQ items as JSON lines; the path of the chunks."""
    if settings.save_raw_html:
        files.write_raw_pages(pages, settings.raw_html_dir)
    path = f"{settings.output_dir}/chunks.jsonl"
    files.write_jsonl(ingest(pages, settings), path)
    written = files.read_jsonl(pages.sparkSession, path, ingest(pages, settings).schema)
    files.write_jsonl(files.faq_items(written), f"{settings.output_dir}/faq_items.jsonl")
    return path


def ask(
    records: DataFrame, questions: DataFrame, settings: Settings = Settings(), *, content_type: str | None = None, program_type: str | None = None,
    embedder: Callable[[], models.Embedder] = models.HashedWords, scorer: Callable[[], models.Scorer] = models.SharedWords,
    generator: Callable[[], models.Generator] = models.FirstSource, nearest: Callable[[DataFrame, int], DataFrame] | None = None,
    corpus: lexical.Corpus | None = None, records_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Answers to ``questions`` (query_id, question) from an index: search, two stages, prompt, model. ``nearest`` and ``records_of`` as in ``retrieve.search``.

    With the word statistics of a ``corpus`` hits are reranked by BM25 and answers drawn from their sentences: no model but the embedder is asked.
    """
    asked = index.embed(questions, "question", model=embedder).select("query_id", "embedding")
    initial = settings.rerank_initial_top_k if settings.use_reranker else settings.rag_top_k
    hits = retrieve.search(records, asked, initial, content_type, program_type, nearest, records_of)
    hits = hits.join(questions, "query_id").select("*", "metadata.url", "metadata.section_title")
    if corpus is not None:
        distinct, final = retrieve.two_stage(hits, settings.rerank_final_top_k, settings.rag_min_score, scored=lambda good: lexical.bm25(good, corpus))
        return generate.answer(questions, final, distinct, said=lexical.extractive_answers(final, corpus))
    distinct, final = retrieve.two_stage(hits, settings.rerank_final_top_k, settings.rag_min_score, scorer if settings.use_reranker else None)
    return generate.answer(questions, final, distinct, generator)
