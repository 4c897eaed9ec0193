"""Files of the pipeline: JSON lines, a FAQ extract, raw pages, CSV."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, fields that are null included; what was there is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def faq_items(chunks: DataFrame) -> DataFrame:
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return chunks.where((F.col("content_type") == "faq") & has("question") & has("answer"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Blank lines are passed over. A missing path is an error that says which step writes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        raise FileNotFoundError(f"no processed records at {path}: run the ingest step first")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def raw_pages(pages: DataFrame) -> DataFrame:
    """(name, html): a file name for each page, the hash of its address."""
    return pages.select(F.concat(T.sha256("url"), F.lit(".html")).alias("name"), "html")


def write_raw_pages(pages: DataFrame, path: str) -> None:
    """Each page in a file of its own, ``<hash>.html``, in a folder that all executors reach: a path or the address of a file system.

    A file is written under a name of the attempt's own and then moved, so a task that runs anew leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        mine = f".{TaskContext.get().taskAttemptId()}.part"
        for batch in batches:
            for name, html in zip(batch.column("name").to_pylist(), batch.column("html").to_pylist(), strict=True):
                with system.open_output_stream(f"{folder}/{name}{mine}") as out:
                    out.write((html or "").encode())
                system.move(f"{folder}/{name}{mine}", f"{folder}/{name}")
            yield batch.select(["name"])

    raw_pages(pages).where("name IS NOT NULL").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def peek(chunks: DataFrame, n: int = 6) -> DataFrame:
    """The first few sections, shortened, to look at."""
    return chunks.select("section_title", "content_type", F.substring("content", 1, 200).alias("content")).limit(n)
