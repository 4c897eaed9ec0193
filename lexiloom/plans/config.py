"""Settings, with defaults; environment variables of the same name in upper case replace them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_SITE = "https://datascience.uchicago.edu/education/masters-programs/ms-in-applied-data-science/"


@dataclass(frozen=True)
class Settings:
    # Seeds and limits that results depend on.
    seed_urls: tuple[str, ...] = (_SITE, f"{_SITE}faqs/", f"{_SITE}course-progressions/", f"{_SITE}instructors-staff/")
    request_timeout_seconds: int = 20
    max_pages: int = 100
    max_retries: int = 3
    min_text_length: int = 120
    max_chunk_tokens: int = 690
    overlap_sentences: int = 1
    embedding_batch_size: int = 32
    rag_top_k: int = 5
    rag_min_score: float = 0.35
    rerank_initial_top_k: int = 20
    rerank_final_top_k: int = 5
    use_reranker: bool = True
    save_raw_html: bool = False
    output_dir: str = "data/processed"
    raw_html_dir: str = "data/raw"
    index_dir: str = "data/index"

    @classmethod
    def from_env(cls) -> Settings:
        given = {}
        for f in fields(cls):
            if (value := os.environ.get(f.name.upper())) is not None:
                kind = type(f.default)
                given[f.name] = tuple(value.split(",")) if kind is tuple else value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**given)
