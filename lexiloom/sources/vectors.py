"""A store of vector records that commits: ``df.write.format("vectors").mode("append").save(path)``.

Tasks write files of their own; a version of the store is a manifest that names files, written once all tasks are done. Until
then nothing is seen, and a write that fails leaves what was there. ``read`` gives the records of a
version, the last of each id. The folder must be one that pyarrow and Spark both reach.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

#: The version and the place in it that a record was written at.
_ORDER = ["_version", "_at"]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    at, name = _opened(path)
    return at.get_file_info(name).type != fs.FileType.NotFound


def _versions(path: str) -> list[int]:
    at, folder = _opened(path)
    found = at.get_file_info(fs.FileSelector(f"{folder}/manifest", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if re.fullmatch(r"\d+\.json", f.base_name))


def manifest(path: str, version: int | None = None) -> dict | None:
    """{version, files, rows, dims, schema} of a version, the last by default; None where there is none."""
    known = _versions(path)
    version = known[-1] if known and version is None else version
    if version not in known:
        return None
    at, folder = _opened(path)
    with at.open_input_stream(f"{folder}/manifest/{version:010d}.json") as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int
    dims: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        last = manifest(path)
        missing = {"id", "embedding"} - set(schema.names)
        if missing:
            raise ValueError(f"records need the columns {sorted(missing)}")
        self.path, self.schema, self.version = path, schema, (last["version"] if last else 0) + 1
        self.token = f"{self.version:010d}-{uuid.uuid4().hex}"
        self.base = None if overwrite else last
        if self.base and StructType.fromJson(self.base["schema"]).simpleString() != schema.simpleString():
            raise ValueError(f"records have columns {schema.simpleString()}, the store has others")
        self.dims = self.base["dims"] if self.base else 0

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        at, folder = _opened(self.path)
        name, dims, rows, out = f"data/{self.token}-{uuid.uuid4().hex}.parquet", self.dims, 0, None
        schema = to_arrow_schema(StructType(self.schema.fields).add("_version", LongType()).add("_at", LongType()))
        first = TaskContext.get().partitionId() << 33
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                lengths = set(batch.column(batch.schema.get_field_index("embedding")).value_lengths().to_pylist())
                dims = dims or next(iter(lengths)) or 0
                if lengths != {dims} or not dims:
                    raise ValueError(f"embeddings of lengths {sorted(lengths, key=str)} in a store of length {dims}")
                if batch.column(batch.schema.get_field_index("id")).null_count:
                    raise ValueError("a record without an id")
                if out is None:
                    at.create_dir(f"{folder}/data")
                    out = pq.ParquetWriter(f"{folder}/{name}", schema, filesystem=at)
                place = pa.array(range(first + rows, first + rows + batch.num_rows), pa.int64())
                table = pa.Table.from_arrays([*batch.columns, pa.array([self.version] * batch.num_rows, pa.int64()), place], names=schema.names)
                out.write_table(table.cast(schema))
                rows += batch.num_rows
            if out:
                out.close()
        except BaseException:
            if out:
                out.close()
                at.delete_file(f"{folder}/{name}")
            raise
        return _Written(name if rows else "", rows, dims if rows else 0)

    def commit(self, messages: list[_Written | None]) -> None:
        """One more manifest; none if there were no records. Lists of unequal length in different tasks are an error, and so is a version that another writer has made meanwhile."""
        made = [m for m in messages if m and m.file]
        if not made:
            return
        dims = {m.dims for m in made}
        if len(dims) > 1:
            self.abort(messages)
            raise ValueError(f"embeddings of lengths {sorted(dims)} in one write")
        if self.version in _versions(self.path):
            self.abort(messages)
            raise ValueError(f"version {self.version} of {self.path} is there already")
        base = self.base or {"files": [], "rows": 0}
        said = {"version": self.version, "files": base["files"] + [m.file for m in made], "rows": base["rows"] + sum(m.rows for m in made), "dims": dims.pop(), "schema": self.schema.jsonValue()}
        at, folder = _opened(self.path)
        at.create_dir(f"{folder}/manifest")
        new = f"{folder}/manifest/{uuid.uuid4().hex}.new"
        with at.open_output_stream(new) as f:
            f.write(json.dumps(said).encode())
        at.move(new, f"{folder}/manifest/{self.version:010d}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        """No manifest, and away with this write's files. A task that dies later may leave one: nothing names it, see :func:`vacuum`."""
        _drop(self.path, lambda name: name.startswith(self.token))


def _drop(path: str, which: Callable[[str], bool]) -> None:
    at, folder = _opened(path)
    for f in at.get_file_info(fs.FileSelector(f"{folder}/data", allow_not_found=True)):
        if which(f.base_name):
            at.delete_file(f.path)


def vacuum(path: str) -> None:
    """Delete files that no version names. Not to be run beside a write."""
    named = {f.removeprefix("data/") for v in _versions(path) for f in manifest(path, v)["files"]}
    _drop(path, lambda name: name not in named)


class VectorStore(DataSource):
    """Records with an id, an embedding, and any other columns; all of one schema and one length of embedding. Mode append puts records in by id, overwrite replaces all."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def put(records: DataFrame, path: str, *, replace: bool = False) -> None:
    """Upsert ``records`` by id; with ``replace`` they are all there is. No records change nothing."""
    records.sparkSession.dataSource.register(VectorStore)
    records.write.format("vectors").mode("overwrite" if replace else "append").option("path", path).save()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The records of a version: of each id that written last. None where no version is."""
    said = manifest(path, version)
    if said is None:
        return None
    schema = StructType.fromJson(said["schema"])
    stored = StructType(schema.fields).add("_version", LongType()).add("_at", LongType())
    rows = spark.read.schema(stored).parquet(*(f"{path}/{f}" for f in said["files"]))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*schema.names), F.struct(*_ORDER)).alias("_last"))
    return last.select("_last.*")


def count(spark: SparkSession, path: str) -> int:
    rows = read(spark, path)
    return rows.select("id").count() if rows is not None else 0


def compact(spark: SparkSession, path: str) -> None:
    """A version whose files hold each id once. Older versions stay readable."""
    rows = read(spark, path)
    if rows is not None:
        put(rows, path, replace=True)


def records_of(spark: SparkSession, ids: Sequence, documents: Sequence, embeddings: Sequence, metadatas: Sequence[dict]) -> DataFrame:
    """Records from lists of equal length; an error if they aren't. Metadata values are strings."""
    if len({len(ids), len(documents), len(embeddings), len(metadatas)}) > 1:
        raise ValueError("ids, documents, embeddings and metadatas differ in length")
    rows = [(str(i), d, [float(x) for x in e], {k: str(v) for k, v in (m or {}).items() if v is not None}) for i, d, e, m in itertools.zip_longest(ids, documents, embeddings, metadatas)]
    return spark.createDataFrame(rows, "id string, document string, embedding array<float>, metadata map<string,string>")
