import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import encoding, lengths, mixing, packing, queries
from tests.conftest import DATA
from tests.llm.data import no_documents, odd_documents

PATH = encoding.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_like_the_tokenizer(tokenizer):
    r = random.Random(1)
    odd = [None, "", " ", "a\x1cb c", "Éa <|endoftext|>x y<|startoftext|>", "a\x85b c", "é é 'S don't WE'LL It's.", "123abc!!! ΑΣ Σ. İstanbul, I.", "😀 x" * 3, "\x01 a \x01\x01b", "x" * 5000, "don't. 'll, s.. a,.", "ﬁne ǅ ß ẞ."]
    odd += [" ".join("".join(r.choice("abEÉß'.,9 -é") for _ in range(r.randint(1, 9))) for _ in range(50)) for _ in range(60)]
    for encoder in (encoding.WordEncoder(PATH), encoding.WordEncoder(PATH, max_words=5, chars=40)):
        for t, ids in zip(odd, encoder.encoded(odd), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_refuses_what_it_cannot_encode():
    """A vocabulary whose pieces begin with their space."""
    import public_tokenizers

    with pytest.raises(ValueError, match="one by one"):
        encoding.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_over_all_code_points(tokenizer):
    """Each code point alone, before and after marks, within and at the end of a word; of ideographs, syllables and what is unassigned every 97th."""
    plain = lambda k: k % 97 and (0x3400 <= k < 0xD800 or k >= 0x17000 and not 0x1AFF0 <= k < 0x20000)
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and not plain(k)]
    texts = []
    for at in range(0, len(points), 500):
        some = points[at : at + 500]
        texts += [" ".join(f.format(c) for c in some) for f in ("{}", "{},", "{}.", "{}'", ",{}", ".{}", "'{}", "ab{}", "ab{}.", "Ab{},", "A{}b.", "{}b,")]
    encoder = encoding.WordEncoder(PATH)
    want = (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False))
    assert all(a == b for a, b in zip(encoder.encoded(texts), want, strict=True))


def check_pieces(rows, ids):
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc, own in docs.items():
        have = sorted((x.tobytes() for x in ids[doc]))
        own.sort(key=lambda r: r.start)
        if len(ids[doc]) == 1:
            assert b"".join(r.ids for r in own) == have[0] and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert sum(r.length for r in own) == sum(map(len, ids[doc])) and all(r.length > 0 and len(r.ids) == 4 * r.length for r in own)
    padded = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and total <= 2048
        padded += 0 if total & (total - 1) == 0 else 2048 - total
    return padded


def test_packing(spark, tokenizer):
    df = odd_documents(spark)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    rows = packing.pack(df, PATH, window_tokens=4000).collect()
    assert {r.doc_id for r in rows} == set(ids) and check_pieces(rows, ids) <= 3 * 2048
    assert sorted(map(repr, rows)) == sorted(map(repr, packing.pack(df, PATH, window_tokens=4000).collect()))
    assert packing.pack(no_documents(spark), PATH).count() == 0 and packing.pack(df.where("text IS NULL"), PATH, end=()).count() == 0


def test_fill_places_all_once():
    r = random.Random(2)
    for _ in range(200):
        pieces = [(r.choice([1, 5, 100, 128, 300, 1024, 2048, 5000, r.randint(1, 9000)]), k, 0) for k in range(r.randint(0, 40))]
        windows, left = packing.fill(pieces, packing.TIERS)
        assert all(sum(p[0] for p in w) == t for t, w in windows) and sum(p[0] for p in left) < packing.TIERS[-1]
        windows += packing._last(left, packing.TIERS)
        runs = defaultdict(list)
        for _, w in windows:
            for n, d, s in w:
                runs[d].append((s, n))
        for n, d, _ in pieces:
            at = 0
            for s, m in sorted(runs[d]):
                assert s == at
                at += m
            assert at == n
        groups = packing.step_groups(windows, 1 << 14)
        sums = np.bincount(groups, weights=[t for t, _ in windows]) if windows else [0]
        assert max(sums) - min(sums) <= 2048


def test_op3_query(spark, tokenizer):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op3_packing(spark, DATA).collect()
    for r in rows:
        x = np.array(tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())


def test_lengths(spark, tokenizer):
    df = odd_documents(spark)
    n = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()]
    sums = lengths.with_suffix_sums(lengths.histogram(df, PATH))
    for r in sums.collect():
        ge = [x for x in n if x >= r.length]
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.docs_le) == (n.count(r.length), len(ge), sum(ge), sum(x <= r.length for x in n))
        assert r.truncated_tokens == sum(min(x, r.length) for x in n)
    for r in lengths.at_limits(sums, [0, 1, 7, 512, 10**9]).collect():
        assert (r.n_docs_over, r.truncated_tokens, r.total_tokens) == (sum(x > r.context_limit for x in n), sum(min(x, r.context_limit) for x in n), sum(n))
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.length == min(x for x in n if sum(y <= x for y in n) >= r.share * len(n))
    assert lengths.with_suffix_sums(lengths.histogram(no_documents(spark), PATH)).count() == 0


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights, total, most):
    """Shares of the total by weight; what exceeds ``most`` times a size is shared anew, source by source."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        unit = rest / sum(weights[k] for k in free)
        if not (over := [k for k in free if unit * weights[k] > most * sizes[k]]):
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            rest -= out[k]
        free = [k for k in free if k not in over]
    return out


def test_targets(spark):
    assert targets([10, 10, 10], [3, 1, 2], 45, 2) == [20, 25 / 3, 50 / 3] and targets([0, 5], [1, 1], 7.5, 2) == [0, 7.5]
    r = random.Random(5)
    for n in (0, 1, 7, 300):
        names = sorted({"".join(r.choice("aZé😀\uffee") for _ in range(r.randint(0, 6))) for _ in range(n)}) + [None] * (n > 1)
        sizes = [r.choice([0, 1, 10, 1000, 10**12]) for _ in names]
        rows = list(zip(names, sizes, strict=True))
        r.shuffle(rows)
        got = {x.source: x for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5), (3, 1, 2), 1.5, 2).collect()}
        want = targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
        assert len(got) == len(names) and [got[s].k for s in names] == list(range(len(names))) and np.allclose([got[s].target for s in names], want)


def test_hypergeometric():
    """Against exact probabilities where these can be listed, against mean and spread where not."""
    from math import comb

    for good, bad, draws in ((7, 5, 4), (30, 50, 20), (50, 30, 60), (200, 1000, 500), (1000, 3, 15)):
        rng, n = np.random.default_rng(good), 20_000
        seen = np.bincount([mixing.hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=draws + 1)
        want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(draws + 1)])
        assert not seen[want == 0].any()
        often = want * n > 5
        assert ((seen - want * n)[often] ** 2 / (want * n)[often]).sum() < often.sum() + 5 * math.sqrt(2 * often.sum()) + 1, (good, bad, draws)
    for good, bad, draws in ((3 * 10**9, 7 * 10**9, 10**9), (10**15, 10**14, 9 * 10**14), (10**13, 10**13, 5)):
        rng, total = np.random.default_rng(1), good + bad
        x = np.array([mixing.hypergeometric(rng, good, bad, draws) for _ in range(2000)], dtype=np.float64)
        mean, spread = draws * good / total, math.sqrt(draws * good / total * bad / total * (total - draws) / (total - 1))
        z = (x - mean) / spread
        assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.08 and (draws < 10 or abs((z**3).mean()) < 0.3 and len(set(x)) > 1900)


def test_split_quota():
    r = random.Random(3)
    for k in range(60):
        sizes = [r.choice([0, 1, 5, 900]) for _ in range(r.randint(1, 20))]
        q = r.randint(0, sum(sizes))
        out = mixing.split_quota(sizes, q, [k])
        assert sum(out) == q and all(0 <= a <= b for a, b in zip(out, sizes, strict=True)) and out == mixing.split_quota(sizes, q, [k])
    big = mixing.split_quota([10**13] * 4, 2 * 10**13, [1])
    assert sum(big) == 2 * 10**13 and all(0 < abs(x - 5 * 10**12) < 10**8 for x in big)


def test_mix(spark):
    df = odd_documents(spark).where("length(text) < 100 OR text IS NULL").union(odd_documents(spark).where("doc_id = 9"))
    rows = mixing.mix(df, shards=4).collect()
    assert len(rows) == df.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    own, aim = defaultdict(int), {}
    for r in rows:
        own[r.source] += r.taken
        aim[r.source] = r.target
    assert all(abs(own[s] - aim[s]) <= 1 for s in own) and abs(sum(aim.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    again = mixing.mix(df.repartition(7), shards=4).collect()
    assert sorted((str(r.doc_id), r.content, r.taken) for r in rows) == sorted((str(r.doc_id), r.content, r.taken) for r in again)
    out = mixing.mixed(df, shards=4)
    assert out.columns == df.columns and sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(no_documents(spark)).count() == 0 == mixing.mixed(no_documents(spark)).count()


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(8)
    leaves = [(k, s, r.randint(0, 50)) for k in range(4) for s in range(40) if r.random() < 0.8]
    sums = Counter()
    for k, _, n in leaves:
        sums[k] += n
    plan = spark.createDataFrame([(k, n // 3) for k, n in sums.items()], "k long, quota long")
    got = {(x.k, x.shard): x.share for x in mixing._quotas(spark.createDataFrame(leaves, "k long, shard int, size long"), plan, 40, 1).collect()}
    assert len(got) == len(leaves) and all(0 <= got[k, s] <= n for k, s, n in leaves)
    assert all(sum(v for (j, _), v in got.items() if j == k) == n // 3 for k, n in sums.items())


@pytest.mark.parametrize("per_shard", [20_000, 20])
def test_local_shuffle(spark, per_shard):
    """Places are distinct in a shard, sources are interleaved and the copies of a row apart; rows that repeat are spread."""
    docs = [(k, f"text {k} of some words", f"s{k % 4}") for k in range(400)] + [(7777, "one row again and again", "s1")] * 200
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    rows = mixing.mix(df, shards=4, rows_per_shard=per_shard).collect()
    assert len(rows) == 600 and sum(r.taken for r in rows) == round(1.5 * 5 * 600)
    by = defaultdict(list)
    for r in rows:
        by[r.shard] += [(p, r.source, r.doc_id) for p in r.places]
        assert len(r.places) == r.epochs + (r.drawn > 0)
    assert len({r.shard for r in rows if r.doc_id == 7777}) == (1 if per_shard == 20_000 else len(by))
    changes = near = 0
    for own in by.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(1, len(own) + 1))
        changes += sum(a[1] != b[1] for a, b in zip(own, own[1:], strict=False))
        near += sum(a[2] == b[2] != 7777 for a, b in zip(own, own[1:], strict=False))
    assert changes > 300 and near < (20 if per_shard == 20_000 else 60)  # small shards hold many copies side by side by chance
    out = [(r.source, r.text) for part in mixing.mixed(df, shards=4, rows_per_shard=per_shard).rdd.glom().collect() for r in part]
    assert Counter(out)[("s1", "one row again and again")] >= 200 and sum(words(t) for _, t in out) == sum(r.taken for r in rows)
    assert sum(a[0] != b[0] for a, b in zip(out, out[1:], strict=False)) > 300


def test_cut_text_keeps_its_white_space(spark):
    df = spark.createDataFrame([(1, "  a\n\nb  c d", "s", 11)], "doc_id long, text string, source string, n_chars long")
    out = mixing.mixed(df, share=0.5, shards=1).collect()
    assert [(r.text, r.n_chars) for r in out] == [("  a\n\nb", 6)]


def test_op5_query(spark):
    rows = queries.op5_mixing(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {d.doc_id: words(d.text) for d in docs}
    by = defaultdict(int)
    for d in docs:
        by[d.source] += size[d.doc_id]
    names = sorted(by)
    aims = dict(zip(names, targets([by[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(by.values()), 2), strict=True))
    source = {d.doc_id: d.source for d in docs}
    assert all(r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - aims[source[r.doc_id]]) < 1e-6 for r in rows)
    got = defaultdict(int)
    for r in rows:
        got[source[r.doc_id]] += r.taken
    assert all(abs(got[s] - aims[s]) <= 1 for s in names)


def test_op6_query(spark, tokenizer):
    n = [len(tokenizer.encode(d.text or "", add_special_tokens=False).ids) for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.op6_token_counts(spark, DATA).collect()
    assert {r.length: r.n_docs for r in rows} == Counter(n)
    for r in rows:
        ge = [x for x in n if x >= r.length]
        assert (r.docs_ge, r.tokens_ge, r.docs_le, r.truncated_tokens) == (len(ge), sum(ge), sum(x <= r.length for x in n), sum(min(x, r.length) for x in n))
