"""A clustered inverted file: search that reads a part of the index, and exact search that reads what it must.

Vectors lie in lists by their nearest centroid, each list in blocks of some thousand vectors, a row each, and
lists are partitions of the table: what no query probes is not read. Centroids are fitted by k-means
on a bounded sample, every vector is filed. How many lists a query probes is measured when the file is built:
as many as hold ``recall`` of the exact neighbours of sampled queries. Exact search asks the probed lists first and
then all that may hold something nearer, by the triangle inequality of angles and the lists' radii.

Queries are a table and stay one: those that probe a list meet its blocks in blocks of their own, so that a product of
matrices has a fixed size at most whatever the number of queries and however full a list is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from .retrieve import sound_units, topk_cosine

#: Vectors of a block and queries of a block, about; the most lists there are; floats of all centroids at most.
BLOCK, QUERIES, LISTS, CENTROIDS = 1024, 1024, 4096, 1 << 22
#: Floats that a task's products with the centroids have, and of the vectors that it passes on at once.
PRODUCT = 1 << 20
#: Angles are compared with this to spare.
SLACK = 1e-7


@dataclass(frozen=True)
class InvertedFile:
    """A built file: its folder, and what the driver keeps of it, which is bounded by the number of lists."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    filled: np.ndarray
    probes: int

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def _fitted(rows: DataFrame, n: int, dims: int, sample: int, lists: int | None) -> np.ndarray:
    """Centroids of unit length, by k-means with cosine distance on ``sample`` vectors at most, those of the least hashes."""
    k = min(lists or round(math.sqrt(n)), LISTS, max(1, CENTROIDS // dims), max(1, min(n, sample) // 4))
    if k < 2:
        return rows.limit(1).select("unit").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, dims)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("unit").alias("features"))
    picked = picked.cache()
    model = KMeans(k=k, seed=7, maxIter=12, distanceMeasure="cosine").fit(picked)
    picked.unpersist()
    return sound_units([c.tolist() for c in model.clusterCenters()], dims)[1]


def _arrow(fields: dict[str, DataType]) -> tuple[StructType, pa.Schema]:
    kind = StructType([StructField(name, t) for name, t in fields.items()])
    return kind, to_arrow_schema(kind)


def _rows(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sound(index: DataFrame, id: str, vector: str) -> tuple[DataFrame, int | None, int]:
    """((id, unit) of the vectors that can be compared, their length, how many they are at most); an error if lengths differ."""
    vectors = index.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")
    least, dims, n = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count("*")).first()
    if least != dims:
        raise ValueError(f"vectors of unequal length, {least} to {dims}")
    kind, _ = _arrow({"id": vectors.schema["id"].dataType, "unit": ArrayType(DoubleType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live, units = sound_units(batch.column(1).to_pylist(), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), _rows(units)], ["id", "unit"])

    return vectors.mapInArrow(run, kind), dims, n


def _filed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (id, unit) with list, the nearest centroid, and the angle to it."""
    kind, _ = _arrow({"id": rows.schema["id"].dataType, "unit": ArrayType(DoubleType()), "list": IntegerType(), "angle": DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCT // len(centroids))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            near = _matrix(batch.column(1), centroids.shape[1]) @ centroids.T
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(angle)], ["id", "unit", "list", "angle"])

    return rows.mapInArrow(run, kind)


def _probes(filed: DataFrame, centroids: np.ndarray, recall: float, k: int, asked: int) -> int:
    """The least number of nearest lists that hold ``recall`` of the k exact neighbours of ``asked`` vectors, those of the least hashes."""
    queries = filed.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(asked).select(F.col("id").alias("query_id"), F.col("unit").alias("embedding"))
    hits = topk_cosine(filed, queries, k, vector="unit", exclude_same=True).select("query_id", "id")
    known = hits.join(F.broadcast(queries), "query_id").join(filed.select("id", "list"), "id").select("embedding", "list").toPandas()
    if known.empty:
        return 1
    near = np.stack(known["embedding"].to_numpy()) @ centroids.T
    place = (near > near[np.arange(len(near)), known["list"].to_numpy()][:, None]).sum(axis=1)
    return int(np.sort(place)[min(len(place), math.ceil(recall * len(place))) - 1]) + 1


def build(index: DataFrame, path: str, *, id: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = 20_000, recall: float = 0.95, k: int = 10, asked: int = 256) -> InvertedFile:
    """An inverted file of ``index`` under ``path``, a folder that all executors share; what was there is replaced.

    Ids are unique. There are about as many lists as the square root of the number of vectors, ``LISTS`` at most. Centroids are fitted on ``sample``
    vectors, the number of probes on ``asked`` of them; all are filed. Vectors that are null, empty or zero or hold null or
    non-finite components are nobody's neighbours and in no list. An empty index makes an empty file.
    """
    spark = index.sparkSession
    rows, dims, n = _sound(index, id, vector)
    centroids = _fitted(rows, n, dims, sample, lists) if n else np.zeros((0, dims or 1))
    filed = _filed(rows, centroids) if len(centroids) else rows.selectExpr("id", "unit", "0 AS list", "0D AS angle").limit(0)
    filed.write.mode("overwrite").parquet(f"{path}/filed")
    filed = spark.read.schema(filed.schema).parquet(f"{path}/filed")
    sizes = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    blocks = filed.join(F.broadcast(sizes), "list").groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("id", "unit")).alias("own"))
    blocks = blocks.select("block", F.transform("own", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("own", lambda x: x["unit"])).alias("units"), "list")
    blocks.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/blocks")
    probes = _probes(filed, centroids, recall, k, asked) if len(centroids) else 1
    radius = {r["list"]: (r["radius"], r["n"]) for r in sizes.collect()}  # a row for each list
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/filed")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    kept = [(nth, c.tolist(), *radius.get(nth, (0.0, 0)), probes) for nth, c in enumerate(centroids)]
    spark.createDataFrame(kept, "list int, centroid array<double>, radius double, n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> InvertedFile:
    kept = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # a row for each list
    dims = len(kept[0]["centroid"]) if kept else 1
    return InvertedFile(spark, path, np.array([r["centroid"] for r in kept]).reshape(-1, dims), np.array([r["radius"] for r in kept]), np.array([r["n"] for r in kept], np.int64), kept[0]["probes"] if kept else 1)


def _probed(queries: DataFrame, file: InvertedFile, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, unit, list) of the lists that ``wanted`` marks, given each query's cosines with the centroids and its bound."""
    dims = file.centroids.shape[1]
    kind, _ = _arrow({"query_id": queries.schema["query_id"].dataType, "unit": ArrayType(DoubleType()), "list": IntegerType()})
    centroids, filled = file.centroids, file.filled > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(QUERIES, PRODUCT // len(centroids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                live, units = sound_units(part.column(1).to_pylist(), dims)
                bound = part.column(2).to_numpy(zero_copy_only=False)[live]
                row, lists = np.nonzero(wanted(units @ centroids.T, bound) & filled)
                # A query goes out once for each list that it probes: in pieces, as there may be thousands.
                most = max(1, PRODUCT // dims)
                for own, those in ((row[k : k + most], lists[k : k + most]) for k in range(0, len(row), most)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(live[own])), _rows(units[own]), pa.array(those.astype(np.int32))], ["query_id", "unit", "list"])

    return queries.select("query_id", "embedding", "bound").mapInArrow(run, kind)


def _scored(file: InvertedFile, probed: DataFrame, k: int, exclude_same: bool) -> DataFrame:
    """(query_id, id, score): of each block that a query probes, the k nearest."""
    spark, dims = file.spark, file.centroids.shape[1]
    counts = probed.groupBy("list").agg(F.count("*").alias("n"))
    lists = [r["list"] for r in counts.select("list").collect()]  # each list once at most
    parts = F.ceil(F.col("n") / QUERIES).cast("int")
    asked = probed.join(F.broadcast(counts), "list").groupBy("list", F.pmod(F.xxhash64("query_id"), parts).alias("part")).agg(F.collect_list(F.struct("query_id", "unit")).alias("own"))
    asked = asked.select("list", F.transform("own", lambda x: x["query_id"]).alias("query_ids"), F.flatten(F.transform("own", lambda x: x["unit"])).alias("asked"))
    blocks = file.blocks()
    if len(lists) < len(file.filled):
        blocks = blocks.where(F.col("list").isin(lists))
    met = blocks.join(asked, "list").select("ids", "units", "query_ids", "asked")
    kind, _ = _arrow({"query_id": probed.schema["query_id"].dataType, "id": blocks.schema["ids"].dataType.elementType, "score": DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, names = batch.column(0)[r].values, batch.column(2)[r].values
                scores = np.asarray(batch.column(3)[r].values).reshape(-1, dims) @ np.asarray(batch.column(1)[r].values).reshape(-1, dims).T
                if exclude_same:
                    own = {v: at for at, v in enumerate(ids.to_pylist())}
                    same = [(at, own[v]) for at, v in enumerate(names.to_pylist()) if v in own]
                    scores[[a for a, _ in same], [b for _, b in same]] = -np.inf
                if scores.shape[1] > k:  # all that tie with the k-th stay
                    least = np.partition(scores, -k, axis=1)[:, -k]
                    row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                else:
                    row, at = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(at)), pa.array(scores[row, at])], ["query_id", "id", "score"])

    return met.mapInArrow(run, kind)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest_lists(n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def wanted(near: np.ndarray, _: np.ndarray) -> np.ndarray:
        if n >= near.shape[1]:
            return np.ones(near.shape, bool)
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argpartition(-near, n - 1, axis=1)[:, :n], True, axis=1)
        return out

    return wanted


def search(file: InvertedFile, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False, exclude_same: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for each of ``queries`` (query_id, embedding) the k nearest by cosine; ties by id.

    ``probes`` lists are asked, by default as many as were found to give the file's recall. ``exact=True`` then asks every list that can hold a
    nearer vector, so the result is that of a whole scan. Queries without a direction, as vectors that aren't filed, find nothing;
    queries of another length than the file's find nothing either.
    """
    asked = queries.select("query_id", "embedding", F.lit(0.0).alias("bound"))
    if not len(file.centroids):
        kind, _ = _arrow({"query_id": queries.schema["query_id"].dataType, "id": queries.schema["query_id"].dataType, "score": DoubleType(), "rank": IntegerType()})
        return file.spark.createDataFrame([], kind)
    first = _nearest_lists(probes or file.probes)
    found = _scored(file, _probed(asked, file, first), k, exclude_same)
    if not exact:
        return _best(found, k)
    found = _best(found, k).drop("rank").checkpoint()
    # The k-th score so far; -1 with fewer.
    so_far = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("bound"))
    radius = file.radius

    def may_hold(near: np.ndarray, bound: np.ndarray) -> np.ndarray:
        reach = np.arccos(np.clip(near, -1, 1)) - radius
        return ~first(near, bound) & (reach <= np.arccos(np.clip(bound, -1, 1))[:, None] + SLACK)

    again = queries.join(so_far, "query_id", "left").select("query_id", "embedding", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    return _best(found.unionByName(_scored(file, _probed(again, file, may_hold), k, exclude_same)), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the pairs (query_id, id) of ``exact`` that ``found`` has."""
    both = exact.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
