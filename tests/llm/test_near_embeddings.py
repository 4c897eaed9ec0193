import os
import random

import numpy as np
import pytest

from pyspark.sql import DataFrameWriter, functions as F

from lexiloom.llm import embeddings, graph, near, queries, store, text
from tests.conftest import DATA
from tests.llm.data import no_documents, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(sets, similarity=80):
    """Least position reachable, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n", [4, 5])
def test_near_like_brute_force(spark, n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " ", "", "AAA bbb", "aaa BBB"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in near.near_duplicates(df, words=n).collect()}
    sets = [shingles(t, n) for t in texts]
    want = linked(sets)
    assert [got[i].component_id for i in ids] == want and [got[i].n_shingles for i in ids] == [len(s) for s in sets]
    assert [got[i].kept for i in ids] == [i == c for i, c in zip(ids, want, strict=True)]


def test_hot_group_makes_few_pairs(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(300):
        copy = list(base)
        for at in r.sample(range(100), r.randint(0, 8)):
            copy[at] = f"e{k}_{at}"
        texts.append(" ".join(copy))
    made = []
    real = near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *a: (made.append(pairs.count()), real(pairs, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near.near_duplicates(df, words=4).collect()}
    assert [got[k] for k in range(300)] == linked([shingles(t, 4) for t in texts]) and sum(made) < 300 * 299 / 8


def test_near_takes_odd_rows(spark):
    rows = near.near_duplicates(odd_documents(spark)).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert len(rows) == odd_documents(spark).count() and {x.component_id for x in by[7] + by[8]} == {6} and sorted(x.component_id or 0 for x in by[None]) == [0, 6]
    assert sum(x.kept for x in by[6] + by[7] + by[8] + by[None]) == 2 and all(by[k][0].kept for k in (1, 2, 3, 4, 5, 9, 10, 11))
    assert near.near_duplicates(no_documents(spark)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_driver_builds_no_large_hash_table(spark, monkeypatch):
    """A table of 0.8 MB on disk, less than Spark would broadcast, is not while another is saved; one of a few rows is."""
    name, plans = "spark.sql.autoBroadcastJoinThreshold", []
    before, write = spark.conf.get(name), DataFrameWriter.parquet
    ids = store.saved(spark.range(100_000).select(F.xxhash64("id").alias("h")))
    few = store.saved(ids.limit(10))
    assert "BroadcastHashJoin" in _plan(ids.join(ids.withColumnRenamed("h", "g"), F.col("h") == F.col("g")))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (plans.append(_plan(self._df)), write(self, path))[1])
    assert store.saved(ids.join(ids.withColumnRenamed("h", "g"), F.col("h") == F.col("g"))).count() == 100_000
    assert store.saved(ids.join(few, "h")).count() == 10
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0] and "BroadcastHashJoin" in plans[1]
    assert spark.conf.get(name) == before
    spark.conf.set(name, "-1")
    try:
        store.saved(ids.join(few.withColumnRenamed("h", "g"), F.col("h") == F.col("g")))
    finally:
        spark.conf.set(name, before)
    assert "Broadcast" not in plans[2]


def test_results_are_merged_by_row(spark):
    """What grows with the input and is joined after the last table is saved."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    found = near.near_duplicates(docs)
    kept = text.only(docs, store.saved(found.where("kept").select("doc_id", "content")))
    assert all("SortMergeJoin" in _plan(x) and "Broadcast" not in _plan(x) for x in (found, kept))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_signatures_guarantee():
    """Signatures that differ in fewer than twice as many symbols as chunks share a key."""
    rng = np.random.default_rng(2)
    low = rng.integers(0, 2**32, (1, near.SYMBOLS), dtype=np.uint32)
    for _ in range(300):
        other = low.copy()
        at = rng.choice(near.SYMBOLS, 2 * near.CHUNKS - 1, replace=False)
        other[0, at] ^= np.uint32(0x5A5A5A5A)
        assert set(near.signature_keys(low)[0]) & set(near.signature_keys(other)[0])


def test_bounds_hold_for_all_sets(spark):
    """No pair that is similar enough is ever left out, whatever the sizes."""
    rng = np.random.default_rng(3)
    rows, want = [], []
    for _ in range(150):
        n = int(rng.choice([1, 5, 60, 900, 6000]))
        union = rng.integers(0, 2**64, n + 1, dtype=np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        a, b = union[: n - drop // 2], union[drop - drop // 2 :]
        side = lambda s: {"n": len(s), "shared": len(s), "rest": len(s) - int(np.bitwise_count(near.bitmap(s).view(np.uint64)).sum()), **{f"w{k}": int(v) for k, v in enumerate(near.bitmap(s))}}
        rows.append((side(a), side(b)))
        both = len(np.intersect1d(a, b))
        want.append(100 * both >= 80 * (len(a) + len(b) - both))
    kind = "struct<n:long,shared:long,rest:long," + ",".join(f"w{k}:long" for k in range(near.MAP)) + ">"
    got = [r.p for r in spark.createDataFrame(rows, f"x {kind}, y {kind}").select(near._plausible("x", "y", 80).alias("p")).collect()]
    assert all(g or not w for g, w in zip(got, want, strict=True)) and not all(got) and any(want)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(v, labels, least):
    norm = [None if x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.array(x, float) / np.linalg.norm(x) for x in v]
    links = np.zeros((len(v), len(v)), bool)
    for i in range(len(v)):
        for j in range(i):
            if norm[i] is not None and norm[j] is not None and labels[i] is not None and labels[i] == labels[j] and norm[i] @ norm[j] >= least:
                links[i, j] = links[j, i] = True
    return links


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    v = [list(map(float, b + rng.standard_normal(24) * s)) for b in base for s in (0, 0.05, 0.15, 0.3)] + [list(map(float, base[0]))] * 3
    v += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, list(map(float, base[1])), list(map(float, base[1] * 7))]
    labels = [k // 60 for k in range(len(v) - 2)] + [None, 0]
    df = spark.createDataFrame([(k, x, y, 0) for k, (x, y) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<double>, label int, row int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links = brute(v, labels, 0.93)
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(v) and found >= 0.98 * links.sum() and all(got[k].n_links <= links[k].sum() for k in got)
    if found == links.sum():
        root = linked([{(min(i, j), max(i, j)) for j in np.flatnonzero(links[i])} for i in range(len(v))], 0)
        assert [got[k].component_id for k in range(len(v))] == root
    assert all(got[k].kept == (got[k].component_id == k) for k in got)
    assert embeddings.near_vectors(df.where("false")).count() == 0 and embeddings.near_vectors(df.where("label IS NULL")).first().n_links == 0


def test_vectors_of_several_lengths(spark):
    """Each length is compared with itself, the rarer ones too; equal beginnings of other lengths don't link."""
    rng = np.random.default_rng(11)
    v = []
    for d, n in ((3, 2), (8, 30), (24, 60), (40, 6)):
        base = rng.standard_normal((n, d))
        v += [list(map(float, b + rng.standard_normal(d) * s)) for b in base for s in (0, 0, 0.02)]
    v += [[*v[-1], 0.0], v[0][:2], [1.0], [2.0], [-1.0]]
    df = spark.createDataFrame([(k, x, 5) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links = np.zeros((len(v), len(v)), bool)
    for d in {len(x) for x in v}:
        own = [k for k, x in enumerate(v) if len(x) == d]
        links[np.ix_(own, own)] = brute([v[k] for k in own], [5] * len(own), 0.93)
    assert [got[k].n_links for k in range(len(v))] == links.sum(1).tolist() and links[:6].any()
    assert [got[k].component_id for k in range(len(v))] == linked([{(min(i, j), max(i, j)) for j in np.flatnonzero(links[i])} for i in range(len(v))], 0)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.stack([a, 0.935 * a + np.sqrt(1 - 0.935**2) * b], 1).reshape(-1, 64)
    df = spark.createDataFrame([(k, list(map(float, x)), 1) for k, x in enumerate(pairs)], "vec_id long, embedding array<double>, label int")
    assert sum(r.n_links for r in embeddings.near_vectors(df).collect()) >= 0.95 * 800


def test_tiny_and_huge_components(spark):
    v = [[1e-200, 0.0], [2e-200, 1e-210], [1e200, 1e-200], [5e-324, 0.0], [0.0, 1e308], [1e-300, 1e300]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4)}


@pytest.mark.parametrize("block", [512, 40])
def test_crowds_like_brute_force(spark, monkeypatch, block):
    """Crowds of near copies, tight and wide, next to each other: counts and components as by all pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((4, 32)))
    base[1] = unit(base[0] + 0.25 * unit(rng.standard_normal(32)))
    v = np.concatenate([unit(base[k] + spread * unit(rng.standard_normal((n, 32)))) for k, (n, spread) in enumerate([(300, 0.1), (250, 0.12), (300, 0.3), (80, 0.02)])] + [unit(rng.standard_normal((150, 32)))])
    v = np.concatenate([v, v[:5]])
    df = spark.createDataFrame([(k, list(map(float, x)), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links = brute(v, [1] * len(v), 0.93)
    have = np.array([got[k].n_links for k in range(len(v))])
    assert (have <= links.sum(1)).all() and have.sum() >= 0.99 * links.sum()
    sure = np.r_[0:550, 850:930]
    assert (have[sure] == links.sum(1)[sure]).all()
    root = linked([{(min(i, j), max(i, j)) for j in np.flatnonzero(links[i])} for i in range(len(v))], 0)
    assert [got[k].component_id for k in sure] == [root[k] for k in sure]


def test_tables_grow_with_the_vectors():
    sizes = [embeddings.tables_for(n, 0.93) for n in (1, 10**4, 65536, 10**6, 10**9, 10**12)]
    assert sizes[:3] == [(16, 4)] * 3 and sizes[3][0] == 20 and [c for c, _ in sizes] == sorted(c for c, _ in sizes) and all(t <= 32 for _, t in sizes)


@pytest.mark.parametrize("at", [DATA, "/root/testdata/check_s", "/root/testdata/check_h"])
def test_op4_query_like_brute_force(spark, at):
    """The tables of the larger tests hold links, one of them a crowd of near copies."""
    if not os.path.exists(at):
        pytest.skip("no such tables here")
    rows = spark.read.parquet(f"{at}/embeddings.parquet").toPandas()
    v = np.array(rows["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, n, root = rows["vec_id"].to_numpy(), np.zeros(len(v), int), rows["vec_id"].to_numpy().copy()
    of_label = []
    for label in rows["label"].dropna().unique():
        own = np.flatnonzero(rows["label"] == label)
        links = v[own] @ v[own].T >= 0.93
        np.fill_diagonal(links, False)
        n[own] = links.sum(1)
        of_label.append((own, links))
    for own, links in of_label:
        before = None
        while before is None or (before != root[own]).any():
            before = root[own].copy()
            root[own] = np.minimum(before, np.where(links, before[None, :], before.max()).min(axis=1))
    got = {r.vec_id: r for r in queries.op4_embedding_dedup(spark, at).collect()}
    assert len(got) == len(ids)
    assert [got[i].n_links for i in ids] == n.tolist() and [got[i].component_id for i in ids] == root.tolist()


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op4_embedding_dedup"])
def test_queries(spark, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    key = "doc_id" if name.startswith("op2") else "vec_id"
    assert all(r.kept == (r[key] == r.component_id) for r in rows)
    if key == "doc_id":
        docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda d: d.doc_id)
        want = linked([shingles(d.text, 4) for d in docs])
        assert {r.doc_id: r.component_id for r in rows} == {d.doc_id: docs[c].doc_id for d, c in zip(docs, want, strict=True)}
