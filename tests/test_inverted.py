"""The inverted file against a scan of everything: exact results, recall, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import inverted, retrieve
from lexiloom.plans import registry
from tests.conftest import DATA

VECTORS = "id long, embedding array<double>, unit string, list string"


def table(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], "clash", "clash") for k, v in enumerate(vectors)], VECTORS).repartition(5)


def nearest(vectors, asked, k):
    sound = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    scaled = {i: np.array(v, float) / np.abs(v).max() for i, v in enumerate(vectors) if sound[i]}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    return {q: sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q))[:k] for q in asked if q in unit}


def crowded(rng):
    """A crowd that is a third of all, clusters, and vectors anywhere."""
    base = rng.standard_normal((20, 16))
    crowd = rng.standard_normal(16) + 0.01 * rng.standard_normal((700, 16))
    return [*crowd, *(base[k % 20] + 0.2 * rng.standard_normal(16) for k in range(900)), *rng.standard_normal((400, 16))]


@pytest.mark.parametrize("block", [1024, 50])
def test_exact_search_equals_a_scan(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(inverted, "BLOCK", block)
    monkeypatch.setattr(inverted, "QUERIES", block)
    vectors = [*crowded(np.random.default_rng(1)), None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1e-200] * 16]
    rows = table(spark, vectors)
    file = inverted.build(rows, str(tmp_path), lists=30)
    asked = rows.where("id % 25 = 0 OR id >= 2000").selectExpr("id AS query_id", "embedding")
    want = nearest(vectors, [r.query_id for r in asked.select("query_id").collect()], 10)
    exact = inverted.search(file, asked, 10, exact=True, exclude_same=True).cache()
    got = {}
    for r in sorted(exact.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(-round(r.score, 9))
    assert {q: [s for s, _ in own] for q, own in want.items()} == got
    quick = inverted.search(file, asked, 10, exclude_same=True)
    assert inverted.recall_of(quick, exact) >= 0.9 and file.probes < 30
    scan = retrieve.topk_cosine(rows, asked, 10, exclude_same=True)
    assert sorted(map(tuple, scan.select("query_id", "id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "id", "rank").collect()))
    again = inverted.opened(spark, str(tmp_path))
    assert again.probes == file.probes and (again.centroids == file.centroids).all() and again.filled.sum() == 2001
    assert inverted.search(again, asked, 10, probes=1).where("rank = 1 AND id <> query_id AND score < 0.999999").count() == 0  # a vector is in its nearest list
    exact.unpersist()


def test_only_probed_lists_are_read(spark, tmp_path):
    file = inverted.build(table(spark, crowded(np.random.default_rng(2))), str(tmp_path), lists=30)
    found = inverted.search(file, table(spark, [[1.0] * 16]).selectExpr("id AS query_id", "embedding"), 5, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 5 and "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_recall_over_the_whole_table(spark):
    """Vectors without any structure are the worst case for lists."""
    quick, exact = (registry.QUERIES[n](spark, DATA) for n in ("topk_inverted", "topk_batch"))
    assert inverted.recall_of(quick, exact) >= 0.9


def test_small_and_wrong_tables(spark, tmp_path):
    asked = table(spark, [[1.0, 0.0]]).selectExpr("id AS query_id", "embedding")
    for k, rows in enumerate(([], [None, [0.0, 0.0]])):
        assert inverted.search(inverted.build(table(spark, rows), f"{tmp_path}/{k}"), asked, 3, exact=True).count() == 0
    one = inverted.build(table(spark, [[2.0, 0.0], [0.0, 1.0]]), f"{tmp_path}/one")
    assert [(r.id, r.score) for r in inverted.search(one, asked, 3).collect()] == [(0, 1.0), (1, 0.0)]
    assert inverted.search(one, table(spark, [[1.0], None]).selectExpr("id AS query_id", "embedding"), 3, exact=True).count() == 0
    with pytest.raises(ValueError, match="unequal length"):
        inverted.build(table(spark, [[1.0, 2.0], [1.0]]), f"{tmp_path}/wrong")


def test_products_are_bounded(spark, monkeypatch):
    """With products of a few rows the result is the same."""
    rows = table(spark, crowded(np.random.default_rng(3))[:300])
    asked = rows.where("id % 7 = 0").selectExpr("id AS query_id", "embedding")
    rounded = lambda: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in retrieve.topk_cosine(rows, asked, 4).collect())
    whole = rounded()
    monkeypatch.setattr(retrieve, "PRODUCT", 100)
    assert rounded() == whole


def test_queries_that_probe_many_lists_go_out_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces of 32 rows, where a query probes 20 lists: each pair once, and the result is that of a scan."""
    monkeypatch.setattr(inverted, "PRODUCT", 256)
    rng = np.random.default_rng(3)
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((400, 8)))], "id long, embedding array<double>")
    asked = index.where("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    file = inverted.build(index, str(tmp_path / "f"), lists=20)
    probed = inverted._probed(asked.coalesce(1).withColumn("bound", F.lit(0.0)), file, inverted._nearest_lists(20))
    assert probed.select("query_id", "list").distinct().count() == probed.count() == 80 * int((file.filled > 0).sum())
    got = {(r.query_id, r.id, r["rank"]) for r in inverted.search(file, asked, 5, exact=True, exclude_same=True).collect()}
    assert got == {(r.query_id, r.id, r["rank"]) for r in retrieve.topk_cosine(index, asked, 5, exclude_same=True).collect()}
