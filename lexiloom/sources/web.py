"""Web pages as a source: ``spark.read.format("web").option("urls", ...)``, and a fetch for crawls."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import html as H, urls as U

SCHEMA = (
    "url string, final_url string, html string, fetched_at timestamp, status_code int, page_title string, canonical_url string, "
    "meta_description string, last_modified string, etag string"
)
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
USER_AGENT = "Mozilla/5.0 (compatible; lexiloom)"

#: What answers a request: url to (final url, status, headers, body).
Transport = Callable[[str, float], tuple[str, int, dict[str, str], str]]


def over_http(url: str, timeout: float) -> tuple[str, int, dict[str, str], str]:
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as r:  # redirects are followed; errors raise
        charset = r.headers.get_content_charset() or "utf-8"
        return r.geturl(), r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode(charset, "replace")


def fetch_page(url: str, transport: Transport = over_http, *, timeout: float = 20, attempts: int = 3, wait: tuple[float, float] = (1, 8)) -> dict:
    """One page as a row of SCHEMA. Failures, of kind as well, are tried again after 1, 2, 4 ... seconds."""
    for attempt in range(attempts):
        try:
            final, status, headers, body = transport(url, timeout)
            if "text/html" not in headers.get("content-type", "").lower():
                raise ValueError(f"not HTML: {url}")
            break
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(min(wait[1], wait[0] * 2**attempt))
    canonicalize = lambda u: U.normalized(u, u) or u.rstrip("/")
    head = H.head_metadata(body)
    canonical = U.normalized(final, head["canonical"]) if head["canonical"] else None
    return {
        "url": canonicalize(url), "final_url": canonicalize(final), "html": body, "fetched_at": datetime.now(timezone.utc), "status_code": status,
        "page_title": head["page_title"], "canonical_url": canonicalize(canonical or final), "meta_description": head["meta_description"],
        "last_modified": headers.get("last-modified"), "etag": headers.get("etag"),
    }


def fetcher(transport: Transport = over_http, **options) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` for crawls: pages that fail are left out."""

    def fetch(frontier: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for url, seq in zip(part["url"], part["seq"], strict=True):
                    try:
                        rows.append(fetch_page(url, transport, **options) | {"seq": seq})
                    except Exception as e:
                        print(f"not fetched: {url}: {e}")
                yield pd.DataFrame(rows, columns=[*_COLUMNS, "seq"])

        return frontier.repartition("url").mapInPandas(run, f"{SCHEMA}, seq long")

    return fetch


class WebSource(DataSource):
    """Option urls: addresses, one a line. A page that fails fails its task, which Spark tries again."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options.get("urls", "").split(), float(self.options.get("timeout", 20)))


class _WebReader(DataSourceReader):
    def __init__(self, urls: Sequence[str], timeout: float) -> None:
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        row = fetch_page(partition.value, timeout=self.timeout)
        yield tuple(row[c] for c in _COLUMNS)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("web")`` known to a session."""
    spark.dataSource.register(WebSource)
