"""Search: exact cosine top-k, filters, threshold, duplicates, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .dedupe import dedupe_hits
from .models import Scorer, SharedWords

MIN_SCORE = 0.35
INITIAL_K, FINAL_K = 20, 5
#: Floats of query vectors that are sent to every task at once, and of scores that a product makes.
QUERY_BLOCK, PRODUCT = 1 << 22, 1 << 22
#: Hits up to which their records are looked up by sending the hits to the index's tasks.
FEW_HITS = 1 << 16


def metadata_filter(**wanted: str | None) -> Column:
    """All named fields equal; fields that are None don't matter."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def sound_units(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of unit length) of the vectors with ``dims`` finite components, not all zero; scaled first, so none over- or underflows."""
    none = [np.nan] * dims
    v = np.array([x if x is not None and len(x) == dims else none for x in vectors], np.float64).reshape(len(vectors), dims)
    most = np.abs(v).max(axis=1, initial=0)
    live = np.flatnonzero(np.isfinite(most) & (most > 0))
    v = v[live] / most[live, None]
    return live, v / np.linalg.norm(v, axis=1, keepdims=True)


def topk_cosine(index: DataFrame, queries: DataFrame, k: int, *, id: str = "id", vector: str = "embedding", query_id: str = "query_id", exclude_same: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for each query the k nearest by cosine, exactly; ties by id.

    ``queries`` (query_id, embedding) are asked in blocks of a fixed size, each sent to all tasks.
    A task scores what it scans by matrix products and passes k rows for each query, so the shuffle
    is k rows a query and task and the index is never moved; each block is one more scan. Filter ``index`` first to search a part.
    Vectors that are null or zero, hold null or non-finite components or have another length are nobody's neighbours.
    """
    rows = queries.select(query_id, "embedding").where("embedding IS NOT NULL").toLocalIterator()
    kinds = index.schema[id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found, block = None, []

    def ask(block: list) -> DataFrame:
        live, units = sound_units([r[1] for r in block], len(block[0][1]))
        sent = index.sparkSession.sparkContext.broadcast(([block[at][0] for at in live], units))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            step = max(1, PRODUCT // max(1, len(names)))
            for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                ids = batch.column(0).to_pylist()
                live, units = sound_units(batch.column(1).to_pylist(), q.shape[1])
                scores = q @ units.T
                for j in range(len(names)):
                    own = scores[j]
                    room = k + exclude_same
                    least = np.partition(own, -room)[-room] if len(own) > room else -np.inf
                    new = [(-own[i], ids[live[i]]) for i in np.flatnonzero(own >= least) if not (exclude_same and ids[live[i]] == names[j])]
                    best[j] = sorted(best[j] + new)[:k]
            rows = [(names[j], i, -s) for j, own in enumerate(best) for s, i in own]
            yield pa.RecordBatch.from_pylist([{"query_id": a, "id": b, "score": c} for a, b, c in rows], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(f"query_id {kinds[1]}, id {kinds[0]}, score double"))
        return index.where(F.col(vector).isNotNull()).select(id, vector).mapInArrow(run, f"query_id {kinds[1]}, id {kinds[0]}, score double")

    for row in rows:
        block.append(row)
        if len(block) * len(row[1]) >= QUERY_BLOCK:
            found, block = ask(block) if found is None else found.unionByName(ask(block)), []
    if block or found is None:
        if not block:
            return index.sparkSession.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, score double, rank int")
        found = ask(block) if found is None else found.unionByName(ask(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    index: DataFrame, queries: DataFrame, k: int = FINAL_K, content_type: str | None = None, program_type: str | None = None,
    nearest: Callable[[DataFrame, int], DataFrame] | None = None, records: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Hits with their record: query_id, id, score, distance, rank, document, metadata.

    ``nearest(queries, k)`` finds (query_id, id, score, rank) in an index of its own, as ``inverted.search`` does; it serves where there is
    no filter. With few hits these are sent to the tasks that scan the records; more meet them by a join on id.

    ``records(hits)`` gives (id, document, metadata) of the hits' ids, where ``index`` has none of a record but its id and vector (and
    what is filtered by): an index of vectors is small, and only of hits the records are worked out. Hits, and what is found of them, are then checkpointed in the session's folder.
    """
    part = index.where(metadata_filter(**{"metadata.content_type": content_type, "metadata.program_type": program_type}))
    whole = content_type is None and program_type is None
    hits = nearest(queries, k) if nearest and whole else topk_cosine(part, queries, k)
    hits = hits.checkpoint() if records else hits
    most = FEW_HITS // max(1, k)
    if queries.limit(most + 1).count() <= most:
        hits = F.broadcast(hits)
    found = records(hits) if records else part
    told = found.select("id", "document", "metadata").join(hits, "id").select("id", *(c for c in hits.columns if c != "id"), "document", "metadata").withColumn("distance", 1 - F.col("score"))
    return told.checkpoint() if records else told


def ordered(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Ranks by score, a missing score last."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("score"), "id")))


def over_threshold(hits: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Hits that score enough, or have no score."""
    return hits.where(F.col("score").isNull() | (F.col("score") >= least))


def best(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """The k best for each query by ``rerank_score``, then score, then id."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rerank_score"), F.desc_nulls_last("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(hits: DataFrame, k: int, model: Callable[[], Scorer] = SharedWords, query: str = "query_id") -> DataFrame:
    """The k best for each query by a model's score of (question, document), as rerank_score and rank."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = model()
        for questions, documents in parts:
            yield pd.Series(made.score(list(questions.fillna("")), list(documents.fillna(""))), dtype="float64")

    return best(hits.withColumn("rerank_score", run("question", "document")), k, query)


def two_stage(
    hits: DataFrame, final_k: int = FINAL_K, least: float = MIN_SCORE, model: Callable[[], Scorer] | None = SharedWords,
    scored: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(distinct hits, final hits): order, duplicates, threshold, then reranking or a cut.

    ``scored`` gives the hits a rerank_score as a table, as ``lexical.bm25`` does, in place of a model.
    """
    distinct = dedupe_hits(hits)
    good = over_threshold(distinct, least)
    if scored is not None:
        return distinct, best(scored(good), final_k)
    if model is None:
        return distinct, ordered(good).where(F.col("rank") <= final_k).withColumn("rerank_score", F.lit(None).cast("double"))
    return distinct, rerank(good, final_k, model)
