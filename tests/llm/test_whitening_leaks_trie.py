"""Whitening, decontamination and the trie of conversations against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest


from lexiloom.llm import decontaminate as D, oracles, queries, trie, whitening as W
from tests.conftest import DATA
from tests.llm.data import no_documents, odd_documents

VECTORS = "vec_id long, embedding array<double>, label int, id string, n int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "clash", 0, "clash") for k, v in rows], VECTORS).repartition(5)


def whitened(vecs, components=32):
    """By the covariance's eigenvectors: n, deviations, eigenvalues, axes, whitened rows."""
    d = max((len(v) for v in vecs), default=0)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in vecs], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    y = (apart / n).astype(float)
    e, axes = np.linalg.eigh(y.T @ y / n)
    by = np.argsort(-e)[:components]
    return n, [int(s) for s in (apart * apart).sum(axis=1)], e[by], axes[:, by].T, y @ axes[:, by] / np.sqrt(np.maximum(e[by], 1e-300)), e.sum()


@pytest.mark.parametrize("at", ["small", DATA])
def test_op11_like_eigenvectors(spark, at, tmp_path):
    if at == "small":
        rng = np.random.default_rng(1)
        vecs = [(k, (rng.standard_normal(6) * [9, 4, 2, 1, 0.5, 0.2]).tolist()) for k in range(400)] + [(400, None), (401, [float("nan")] * 6), (402, [None] * 6), (403, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (3, [1.0] * 6), (404, [])]
        vectors(spark, vecs).write.parquet(f"{tmp_path}/embeddings.parquet")
        at = str(tmp_path)
    else:
        vecs = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    kept = [(k, v) for k, v in vecs if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, apart, e, _, z, total = whitened([v for _, v in kept])
    got = queries.op11_whitening(spark, at).collect()
    assert len(got) == n * len(e) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by = defaultdict(list)
    for r in got:
        by[r.component].append((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened, r.explained))
    order = sorted(range(n), key=lambda k: (kept[k][0] if kept[k][0] is not None else -1, apart[k]))
    for c, rows in by.items():
        rows.sort()
        assert [r[1] for r in rows] == [apart[k] for k in order] and max(abs(r[3] - e[c - 1] / total) for r in rows) < 1e-9 * e[c - 1] / total
        mine, theirs = np.array([r[2] for r in rows]), z[order, c - 1]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


def test_whitening_of_odd_vectors(spark):
    rows, fitted, error = W.whiten(vectors(spark, []))
    assert rows.count() == 0 and fitted.n == 0 and error is None
    rows, fitted, error = W.whiten(vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (2, [2.0, 3.0])]))
    assert [(r.deviation, r.whitened) for r in rows.collect()] == [(0, [None, None])] * 3 and error is None and fitted.explained == (None, None)
    rows, fitted, error = W.whiten(vectors(spark, [(k, [k / 64, -k / 32, 0.5]) for k in range(9)]))
    assert fitted.explained[0] == pytest.approx(1) and fitted.explained[1:] == (0.0, 0.0) and error < 1e-12 and all(r.whitened[1:] == [None, None] for r in rows.collect())
    rows, _, error = W.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e9])]), components=1)
    assert error < 1e-9 and all(r.deviation is None and len(r.whitened) == 1 for r in rows.collect())
    big = [(k, [float(r), 3e5 * float(r)]) for k, r in enumerate(np.random.default_rng(2).standard_normal(50))]
    rows, _, _ = W.whiten(vectors(spark, big))
    assert sorted(r.deviation for r in rows.collect()) == sorted(whitened([v for _, v in big])[1])


def test_factors_meet_in_a_tree(spark):
    x = np.random.default_rng(3).standard_normal((500, 4))
    leaves = spark.createDataFrame([(k, np.linalg.qr(x[k * 10 : k * 10 + 10], mode="r").ravel().tolist()) for k in range(50)], "part long, values array<double>")
    r = W._tree(leaves, lambda rows: np.linalg.qr(rows, mode="r"), 4)
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x)[1])


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(w, most):
    n = min(most, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def leaks(text, items, most):
    """(words, hit places, item ids) of one text, by sets of windows."""
    w, hit, ids = words(text), set(), set()
    for item_id, t in items:
        for g in windows(words(t), most):
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids.add("" if item_id is None else str(item_id))
    return len(w), hit, sorted(ids)


def some_texts(r, n, long=60):
    vocabulary = ["a", "b", "the", "été", "sevenby", "eightbyt", "eightbyu", "fourteenbytesx", "fourteenbytesy", "😀", "X9", "fifteenbyteslong"]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "-", ".\n", "\x00 ", "_"]) for _ in range(r.randint(0, long))) for _ in range(n)]


ITEMS = [(1, "a b the a b"), (1, "sevenby eightbyt"), (2, "été"), (3, None), (4, ""), (None, "the the"), (5, "a b the a b"), (6, "A B, the! A b"), (7, "fourteenbytesx fourteenbytes")]


@pytest.mark.parametrize("block", [D.BLOCK, 40])
def test_contamination_like_loops(spark, monkeypatch, block):
    """With small shards, and with items in one block and in several."""
    monkeypatch.setattr(D, "_searched_once", small_shards(D._searched_once))
    monkeypatch.setattr(D, "_sorted", small_shards(D._sorted))
    r = random.Random(5)
    texts = some_texts(r, 120) + [None, "", "...", "the the", "été"]
    items = ITEMS + [(10 + k, t) for k, t in enumerate(some_texts(r, 12, 9))]
    docs = spark.createDataFrame([(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(list)
    for x in D.contamination(docs, tests, words=4, block=block).collect():
        got[x.doc_id].append((x.n_words, x.n_hit, sorted({p for s in x.spans for p in range(s.start, s.end)}), x.item_ids))
    want = defaultdict(list)
    for k, t in enumerate(texts):
        n, hit, ids = leaks(t, items, 4)
        want[k if k % 9 else None].append((n, len(hit), sorted(hit), ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    clean = [t for t in texts if not leaks(t, items, 4)[2]]
    kept = D.decontaminated(docs, tests, words=4, block=block)
    assert kept.columns == docs.columns and sorted(str(x.text) for x in kept.collect()) == sorted(str(t) for t in clean)


def small_shards(make):
    def made(arg):
        of = make(arg)

        def small(batches):
            D.SHARD = 200
            yield from of(batches)

        return small

    return made


def test_longest_matches_like_loops(spark):
    r = random.Random(6)
    texts, items = some_texts(r, 40), [(k % 5, t) for k, t in enumerate(some_texts(r, 7, 25))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for block in (D.BLOCK, 60):
        rows = D.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
        got = sorted((x.item_id, x.start, x.length) for x in rows)
        runs = lambda w, v: next((n for n in range(len(w), 0, -1) if any(v[k : k + n] == w[:n] for k in range(len(v) - n + 1))), 0)
        best = [(i, k, max(runs(words(t)[k:], words(x)) for x in texts)) for i, t in items for k in range(len(words(t)))]
        assert got == sorted(b for b in best if b[2])
        assert all(words(texts[x.doc_id])[x.at : x.at + x.length] in [words(t)[x.start : x.start + x.length] for i, t in items if i == x.item_id] for x in rows)


def test_suffix_arrays():
    r = random.Random(7)
    for texts in (some_texts(r, 30), ["the a " * 500, "the a " * 500], [None, "", "."], []):
        x, starts = D.symbols(pa.array(texts, pa.string()))
        assert len(starts) == len(texts) + 1
        spelled = b"".join((int(s) >> 8).to_bytes(7, "big").rstrip(b"\0") + (b"" if s & np.uint64(1) else b" ") if s else b"|" for s in x)
        assert spelled.decode() == "".join(" ".join([*words(t), ""]) + "|" for t in texts)
        order = D.suffix_array(x, 64)
        assert sorted(order.tolist()) == list(range(len(x)))
        until = lambda p: x[p : p + 64].tolist() if x[p] else [0]
        cut = [until(p)[: until(p).index(0) + 1] if 0 in until(p) else until(p) for p in order]
        assert cut == sorted(cut)


def test_decontamination_of_odd_documents(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "one two three")], "item_id long, text string")
    got = D.contamination(odd_documents(spark), items).groupBy("n_hit").count().collect()
    assert {x.n_hit: x["count"] for x in got} == {0: 8, 3: 1, 10: 5}
    assert D.contamination(no_documents(spark), items).count() == 0 and D.decontaminated(odd_documents(spark), items).count() == 8
    assert {x.n_hit for x in D.contamination(odd_documents(spark), items.where("false")).collect()} == {0}


def test_op12_like_loops(spark):
    docs, items = ([tuple(r)[:2] for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    own = {}
    for i, t in items:
        for g in windows(words(t), 10):
            own.setdefault(g, set()).add(str(i))
    widths = {len(g) for g in own}
    for r in queries.op12_decontamination(spark, DATA).collect():
        w, hit, ids = words(dict(docs)[r.doc_id]), set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if found := own.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:]
    return out


def nodes_of(built):
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, spared = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        spared[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(spared[q] for q in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], spared[p], digest(p)) for p, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, depth int, key string, name string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], TURNS).repartition(4)


def odd_conversations(r):
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["x", "yy", "", None, "éé😀"])) for c in range(-3, 260) if c % 7 or c == 0 for t in range(r.randint(1, 9))]
    rows += [(900, None, "user", "null turn"), (900, 1, "a", "x"), (900, 1, "a", "x"), (900, 1, None, "tie"), (None, 1, "a", "lost"), (901, 0, "1:", "a"), (902, 0, "1", ":a")]
    return rows + [(c, t, "user", "same") for c in (1000, 1001, 1002) for t in range(40)] + [(c, 0, "hot", "first") for c in range(2000, 2300)]


@pytest.mark.parametrize("run", [64, 3])
def test_op13_like_loops(spark, monkeypatch, tmp_path, run):
    """With runs of 3 the sums over runs are summed over runs again."""
    monkeypatch.setattr(trie, "RUN", run)
    rows = odd_conversations(random.Random(8))
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    assert got == nodes_of(rebuilt(rows))


def test_trie_of_nothing(spark):
    none = conversations(spark, []).where("false")
    assert trie.prefix_trie(trie.branched(trie.numbered(none))).count() == 0
    one = trie.prefix_trie(trie.branched(trie.numbered(conversations(spark, [(7, 0, "user", "gone")])))).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves) for r in sorted(one, key=lambda r: r.depth)][:1] == [(7, 0, None, 1, 1)]


def test_digests_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 2)
    ends = [("hot", c) for c in range(-50, 300)] + [("lone", 5), ("two", 3), ("two", 1000)]
    got = {r.key: r.ends_sha256 for r in trie._digests(spark.createDataFrame(ends, "key string, conv_id long").repartition(3)).collect()}
    want = {k: hashlib.sha256(",".join(map(str, sorted(c for x, c in ends if x == k))).encode()).hexdigest() for k in ("hot", "lone", "two")}
    assert got == want


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_prefix_trie"])
def test_queries_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want.fetchall()))
