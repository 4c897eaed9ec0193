"""The learnt embedder against plain loops, dense algebra and planted copies."""

import collections
import io
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import embedder, index, models
from lexiloom.plans import registry
from lexiloom.plans.config import Settings
from lexiloom.sources import files
from tests.conftest import DATA

DOCUMENTS = [(1, "a b a c. A x1 b"), (2, "b a c d"), (3, "c b a a"), (4, None), (5, ""), (6, "a"), (7, "rare " * 3), (8, "z" * 70 + " b d d a"), (9, "z" * 70), (10, "z" * 70)]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def known(rows, least):
    n = collections.Counter(w for _, t in rows for w in set(words(t)) if len(w) <= 64)
    return {w: (k, n[w]) for k, w in enumerate(sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], w)))}


def told(rows, least, window, met=1):
    """word, other -> (n, pmi), by a loop over places."""
    held, n = known(rows, least), collections.Counter()
    for _, text in rows:
        w = words(text)
        for i in range(len(w)):
            for j in range(len(w)):
                if 0 < abs(i - j) <= window and w[i] in held and w[j] in held:
                    n[w[i], w[j]] += 1
    sums = collections.Counter()
    for (a, _), k in n.items():
        sums[a] += k
    pmi = {p: math.log(k * sum(sums.values()) / (sums[p[0]] * sums[p[1]])) for p, k in n.items()}
    return {p: (n[p], x) for p, x in pmi.items() if x > 0 and n[p] >= met}


@pytest.mark.parametrize("window", [1, 2, 4])
def test_vocabulary_and_information(spark, window):
    docs = table(spark, DOCUMENTS)
    vocabulary = embedder.vocabulary(docs, least=2)
    assert {r.word: (r.id, r.n) for r in vocabulary.collect()} == known(DOCUMENTS, 2)
    assert [r.word for r in embedder.vocabulary(docs, least=2, most=2).orderBy("id").collect()] == ["a", "b"]
    names = {k: w for w, (k, _) in known(DOCUMENTS, 2).items()}
    got = {(names[r.a], names[r.b]): (r.n, pytest.approx(r.pmi)) for r in embedder.information(embedder.company(docs, vocabulary, window=window)).collect()}
    assert {p: got[p] for p in sorted(got)} == told(DOCUMENTS, 2, window)


def test_associations(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") * 2 for _ in range(30))) for k in range(20)]
    want = collections.defaultdict(list)
    for (a, b), (n, pmi) in told(rows, 3, embedder.WINDOW, 3).items():
        want[a].append((-round(pmi, 6), -n, b))
    got = collections.defaultdict(list)
    for r in embedder.associations(table(spark, rows), k=4).orderBy("word", "rank").collect():
        got[r.word].append((-r.pmi, -r.n, r.other))
    assert got == {w: sorted(x)[:4] for w, x in want.items()}


def test_leading_equals_dense_algebra(spark):
    rng = np.random.default_rng(5)
    some = rng.standard_normal((40, 3))
    matrix = some @ np.diag([5.0, -3, 2]) @ some.T
    cells = [(i, j, float(matrix[i, j])) for i in range(40) for j in range(40)]
    frame = spark.createDataFrame(cells, "a long, b long, pmi double").repartition("a").sortWithinPartitions("a", "b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # rows that lie in several batches
    try:
        got = embedder.leading(frame, 40, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values, turned = np.linalg.eigh(matrix)
    best = np.argsort(-np.abs(values))[:3]
    want = turned[:, best] * np.sqrt(np.abs(values[best]))
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-4)


def recall(spark, model, rows, asked):
    vectors = {r.doc_id: np.array(r.embedding) for r in index.embed(table(spark, rows), "text", model=model).collect()}
    found = {r.doc_id: np.array(r.embedding) for r in index.embed(table(spark, asked), "text", model=model).collect()}
    ids, matrix = list(vectors), np.array(list(vectors.values()))
    return np.mean([ids[int((matrix @ v).argmax())] == k for k, v in found.items()])


def topical(seed):
    """Documents of 40 subjects, each with words of its own, of which every thing has two names; and copies that use the other name of nearly all."""
    rng, rows, asked = random.Random(seed), [], []
    for k in range(400):
        subject = k % 40
        things = [rng.randrange(12) for _ in range(30)]
        name = lambda t, which: f"s{subject}t{t}{which}"  # noqa: E731, B023
        rows.append((k, " ".join(name(t, rng.choice("ab")) + rng.choice([" the", " of", ""]) for t in things)))
        if k < 40:
            asked.append((k, " ".join(name(t, "ab"[i % 2]) for i, t in enumerate(things[:8]))))
    return rows, asked


def test_learnt_finds_other_names(spark):
    rows, asked = topical(1)
    learnt = embedder.learn(table(spark, rows))
    subject = lambda of: [(k % 40, t) for k, t in of]
    by_learnt, by_hash = (recall(spark, m, subject(rows), subject(asked)) for m in (learnt.model(), models.HashedWords))
    assert by_learnt >= 0.95 and by_hash < 0.7


def test_learnt_finds_near_copies(spark):
    """Copies of which half of the words are drawn anew from all texts, and excerpts of 40 words."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len(words(r.text)) > 80]
    learnt, rng, pool = embedder.learn(table(spark, docs)).model(), random.Random(1), [w for _, t in docs for w in t.split()]
    copies = [(k, " ".join(rng.choice(pool) if rng.random() < 0.5 else w for w in t.split())) for k, t in docs]
    excerpts = [(k, " ".join(t.split()[20:60])) for k, t in docs]
    assert recall(spark, learnt, docs, copies) > recall(spark, models.HashedWords, docs, copies) + 0.05
    assert recall(spark, learnt, docs, excerpts) >= recall(spark, models.HashedWords, docs, excerpts)


def test_odd_tables(spark, tmp_path):
    rows = [*DOCUMENTS, (None, "a b"), (11, "a b"), (11, "a b")]
    learnt = embedder.learn(table(spark, rows), dims=6, least=2)
    learnt.write(str(tmp_path / "learnt"))
    again = embedder.read(spark, str(tmp_path / "learnt"))
    texts = ["a b c", "", "never seen", "b"]
    one, two = learnt.model()().embed(texts), again.model()().embed(texts)
    assert np.array_equal(one, two) and one.dtype == np.float32
    assert np.allclose(np.linalg.norm(one, axis=1), [1, 0, 1, 1], atol=1e-6)
    for some in ([], [(1, None), (2, "")], [(1, "all alone")]):
        empty = embedder.learn(table(spark, some) if some else spark.createDataFrame([], "doc_id long, text string"))
        assert empty.model()().embed(["a b"]).shape == (1, 64)


def test_query(spark):
    got = registry.QUERIES["learnt_embed"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == {k for k, t in texts.items() if t and t.strip()}
    assert all(len(r.embedding) == 64 and abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in got)


def test_cli_learns_for_a_new_index(spark, tmp_path, monkeypatch, capsys):
    """A relative folder, an index made by what was learnt, a search by it; an index of the substitute can't be given a learnt one."""
    monkeypatch.setenv("OUTPUT_DIR", str(tmp_path / "processed"))
    monkeypatch.setenv("INDEX_DIR", os.path.relpath(tmp_path / "index"))
    rows, _ = topical(2)
    chunks = spark.createDataFrame([(str(k), t, "overview") for k, t in rows], "chunk_id string, content string, content_type string")
    names = ("doc_id", "content_clean", "page_title", "section_title", "program_type")
    files.write_jsonl(chunks.select("*", *(F.lit("").alias(c) for c in names)), str(tmp_path / "processed" / "chunks.jsonl"))
    cli.main(["index", "--learnt"])
    cli.main(["index", "--learnt"])  # once more, by what is there
    assert not isinstance(cli.embeds(spark, Settings.from_env())(), models.HashedWords)
    monkeypatch.setattr("sys.stdin", io.StringIO(f"{rows[7][1]}\n\nquit\nnever"))
    capsys.readouterr()
    cli.main(["search", "--top-k", "1"])
    assert rows[7][1][:200] in capsys.readouterr().out.replace("\\n", " ")
    monkeypatch.setenv("INDEX_DIR", str(tmp_path / "other"))
    cli.main(["index"])
    with pytest.raises(ValueError, match="another embedder"):
        cli.main(["index", "--learnt"])


def test_pairs_are_counted_where_the_words_are(spark, monkeypatch):
    """No join of words, and the same counts when a task holds next to nothing."""
    docs = spark.createDataFrame([(k, f"a b{k % 3} c a {'x' * k} b{k % 2} a c") for k in range(40)] + [(99, None), (100, ""), (101, "a")], "doc_id long, text string")
    known = embedder.vocabulary(docs)
    ids = {r.word: r.id for r in known.collect()}
    want = {}
    for r in docs.collect():
        w = (r.text or "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(i + embedder.WINDOW, len(w) - 1) + 1):
                if w[i] in ids and w[j] in ids:
                    pair = tuple(sorted((ids[w[i]], ids[w[j]])))
                    want[pair] = want.get(pair, 0) + 1
    for held in (embedder.HELD, 4):
        monkeypatch.setattr(embedder, "HELD", held)
        found = embedder.company(docs, known)
        assert {(r.a, r.b): r.n for r in found.collect()} == want and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
