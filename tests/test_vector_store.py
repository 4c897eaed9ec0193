"""The store of vector records: commits, aborts, versions, the last of each id."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import vectors as V

RECORDS = "id string, document string, embedding array<float>"


def records(spark, rows):
    return spark.createDataFrame([(i, d, e) for i, d, e in rows], RECORDS)


def stored(spark, path, version=None):
    return sorted((r.id, r.document) for r in V.read(spark, path, version).collect())


def files(path):
    return sorted(os.listdir(f"{path}/data")) if os.path.isdir(f"{path}/data") else []


def test_upsert_last_wins(spark, tmp_path):
    at = str(tmp_path / "store")
    V.put(records(spark, [(str(k), "old", [1.0, float(k)]) for k in range(50)]).repartition(4), at)
    new = records(spark, [("7", "first", [0.0, 1.0]), ("7", "second", [0.0, 2.0]), ("99", "new", [3.0, 3.0])]).coalesce(1)
    V.put(new, f"file://{at}")
    assert stored(spark, at) == sorted([(str(k), "second" if k == 7 else "old") for k in range(50)] + [("99", "new")])
    assert V.count(spark, at) == 51 and len(stored(spark, at, 1)) == 50 and V.manifest(at)["rows"] == 53
    V.compact(spark, at)
    assert V.manifest(at)["version"] == 3 and V.manifest(at)["rows"] == 51 and len(stored(spark, at)) == 51 and ("7", "old") in stored(spark, at, 1)


def test_nothing_is_a_no_op(spark, tmp_path):
    at = str(tmp_path / "store")
    assert V.read(spark, at) is None and V.count(spark, at) == 0
    V.put(records(spark, []), at)
    assert V.manifest(at) is None and files(at) == []
    V.put(records(spark, [("1", "a", [1.0])]), at)
    V.put(records(spark, [("1", "a", [1.0])]).where("false"), at, replace=True)
    assert V.manifest(at)["version"] == 1


@pytest.mark.parametrize("wrong", ["dies", "length", "null length", "id"])
def test_a_failing_write_leaves_what_was_there(spark, tmp_path, wrong):
    """One task of four fails halfway, after others have written their files."""
    at = str(tmp_path / "store")
    V.put(records(spark, [("1", "a", [1.0, 2.0])]), at)
    before = files(at)
    rows = spark.range(40_000, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("document"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.col("id").alias("n"))
    bad = F.col("n") == 35_000
    if wrong == "dies":
        rows = rows.withColumn("document", F.when(bad, F.raise_error(F.lit("dies"))).otherwise(F.col("document")))
    elif wrong == "id":
        rows = rows.withColumn("id", F.when(~bad, F.col("id")))
    else:
        rows = rows.withColumn("embedding", F.when(bad, F.array(F.lit(1.0)).cast("array<float>") if wrong == "length" else F.lit(None)).otherwise(F.col("embedding")))
    with pytest.raises(Exception):
        V.put(rows.drop("n"), at)
    assert V.manifest(at)["version"] == 1 and stored(spark, at) == [("1", "a")]
    time.sleep(1)  # tasks that are being ended may still leave a file
    V.vacuum(at)
    assert files(at) == before


def test_lengths_and_schemas_must_agree(spark, tmp_path):
    at = str(tmp_path / "store")
    with pytest.raises(Exception):
        V.put(records(spark, [("1", "a", [1.0]), ("2", "b", [1.0, 2.0])]).repartition(2, "id"), at)
    V.vacuum(at)
    assert V.manifest(at) is None and files(at) == []
    V.put(records(spark, [("1", "a", [1.0])]), at)
    for rows in (records(spark, [("2", "b", [1.0, 2.0])]), records(spark, [("2", "b", [1.0])]).drop("document"), records(spark, [("2", "b", [1.0])]).drop("embedding")):
        with pytest.raises(Exception):
            V.put(rows, at)
    assert stored(spark, at) == [("1", "a")]
    V.put(records(spark, [("2", "b", [1.0, 2.0])]).drop("document"), at, replace=True)  # all anew, of another kind
    assert V.read(spark, at).columns == ["id", "embedding"] and V.manifest(at)["dims"] == 2


def test_two_writers_of_one_version(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = records(spark, []).schema
    late = V._Writer(at, schema, False)
    V.put(records(spark, [("1", "a", [1.0])]), at)
    with pytest.raises(ValueError, match="there already"):
        late.commit([_made(late, at)])
    assert stored(spark, at) == [("1", "a")] and len(files(at)) == 1


def _made(writer, at):
    """A file as of a task of the late writer."""
    open(f"{at}/data/{writer.token}-late.parquet", "wb").close()
    return V._Written(f"data/{writer.token}-late.parquet", 1, 1)


def test_records_from_lists(spark, tmp_path):
    with pytest.raises(ValueError, match="differ in length"):
        V.records_of(spark, ["1"], ["a", "b"], [[1.0]], [{}])
    at = str(tmp_path / "store")
    V.put(V.records_of(spark, ["1", "2"], ["a", "b"], [[1.0], [2.0]], [{"k": 1, "none": None}, None]), at)
    assert {r.id: r.metadata for r in V.read(spark, at).collect()} == {"1": {"k": "1"}, "2": {}}
    V.put(V.records_of(spark, [], [], [], []), at)
    assert V.manifest(at)["version"] == 1
