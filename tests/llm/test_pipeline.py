import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import mixing, quality, store
from lexiloom.llm.store import saved
from tests.conftest import DATA
from tests.llm.data import no_documents, odd_documents
from tests.llm.test_near_embeddings import linked, shingles


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = saved(stage(spark, docs, DATA))
    first, good, exact, near, mixed, packed = out.values()
    assert all(d.columns == first.columns for d in (good, exact, near, mixed))
    scored = quality.score(first, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.rows.where(scored.kept()).collect()}
    seen, want = set(), []
    for d in sorted(good.collect(), key=lambda d: d.doc_id):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", d.text)
        if t not in seen:
            seen.add(t)
            want.append(d.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == want
    rows = sorted(exact.collect(), key=lambda d: d.doc_id)
    root = linked([shingles(d.text, 5) for d in rows])
    assert sorted(r.doc_id for r in near.collect()) == [d.doc_id for k, d in enumerate(rows) if root[k] == k]
    taken = {r.doc_id: r.taken for r in mixing.mix(near).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert dict(got) == {d: n for d, n in taken.items() if n}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.default_tokenizer())
    ids = Counter()
    for r in mixed.collect():
        ids[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    have = Counter()
    for r in packed.collect():
        have[r.doc_id] += len(np.frombuffer(r.ids, "<u4"))
    assert have == ids


def test_run(spark):
    """The stages one after the other; a run leaves its last input alone and others' tables where they are."""
    mine = saved(spark.range(3))
    mark = store.marked()
    out = corpus_pipeline.run(spark, DATA)
    assert out.agg(F.sum("length")).first()[0] > 0 and store.marked() == mark + 1 and mine.count() == 3


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Cluster:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Cluster())
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stages_take_odd_and_no_rows(spark):
    """Each stage keeps what its docstring says of null, empty, repeated and very long texts, and all other columns."""
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    all_rows, kept = (Counter(map(repr, rows)) for rows in (docs.collect(), stages["quality classifier"](spark, docs, DATA).collect()))
    assert all(kept[x] in (0, n) for x, n in all_rows.items()) and not kept - all_rows  # repeated rows all stay or all go
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()]
    out = stages["exact dedup"](spark, docs, DATA).collect()
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out) == sorted(set(texts)) and all(r.key == "clash" for r in out)
    out = stages["near dedup"](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 1, 10: 1, 11: 1, None: 1}) and next(r for r in out if r.doc_id is None).text is None
    out = stages["source mixing"](spark, docs, DATA)
    assert out.columns == docs.columns and out.where("trim(text) = '' OR text IS NULL").count() == 0
    out = stages["packing"](spark, docs, DATA)
    assert out.where("start = 0").count() == docs.count() and out.where("start = 0 AND doc_tokens = 1").count() == 4
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, no_documents(spark), DATA)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
