import random
import re

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import chunk, crawl, dedupe, evaluate, generate, index, models, retrieve
from tests.test_text import clean, count, sentences


def packed(text, most=690, overlap=1):
    out, cur, n = [], [], 0
    for s in sentences(text):
        k = count(s)
        if k > most:
            out += [" ".join(cur)] if cur else []
            w, step = s.split(), max(80, int(most * 0.55))
            out += [" ".join(w[i : i + step]) for i in range(0, len(w), step)]
            cur, n = [], 0
            continue
        if cur and n + k > most:
            out.append(" ".join(cur))
            cur = cur[-overlap:] if overlap else []
            n = count(" ".join(cur)) if cur else 0
        cur.append(s)
        n += k
    return [c for c in map(clean, out + ([" ".join(cur)] if cur else [])) if c]


@pytest.mark.parametrize("most,overlap", [(690, 1), (100, 1), (60, 2), (60, 0)])
def test_chunks_like_a_loop(spark, most, overlap):
    r = random.Random(most + overlap)
    texts = [" ".join(("W" if r.random() < 0.5 else "4") + "ord " * r.choice([1, 5, 30, 200]) + r.choice(".!?,") for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    for row in df.select("k", chunk.chunk_texts("x", most, overlap).alias("y")).collect():
        assert row.y == packed(texts[row.k], most, overlap)


SECTION = "doc_id string, url string, section_title string, content string, content_clean string, content_summary string, parent_doc_id string, chunk_id string, chunk_index int, chunk_count int, is_chunk boolean, token_count int, char_count int, page_seq int, section_seq int, label string"


def section(spark, rows):
    full = [(d, u, t, c, c, "", None, d, 0, 1, False, count(c), len(c or ""), p, s, "keep") for d, u, t, c, p, s in rows]
    return spark.createDataFrame(full, SECTION)


def test_chunk_rows(spark):
    import hashlib

    long = "This sentence has a number of words in it. " * 200
    rows = chunk.chunk_sections(section(spark, [("a", "u", "t", "short", 0, 0), ("b", "u", "t", long, 0, 1)])).orderBy("section_seq", "chunk_index").collect()
    want = packed(long)
    assert (rows[0].chunk_id, rows[0].is_chunk, rows[0].chunk_count, rows[0].parent_doc_id) == ("a", False, 1, None)
    assert [r.content for r in rows[1:]] == want and {r.chunk_count for r in rows[1:]} == {len(want)} and {r.label for r in rows} == {"keep"}
    assert rows[2].parent_doc_id == "b" and rows[2].doc_id == hashlib.sha256(f"b|chunk|1|{want[1]}".lower().encode()).hexdigest() and rows[2].token_count == count(want[1])


def fold(rows):
    seen, out = {}, []
    for d, u, t, c, *_ in rows:
        key, near = (u, t, c), c
        if key in seen or (near in seen and seen[near] == u):
            continue
        seen[key] = seen[near] = u
        out.append(d)
    return out


def test_section_dedupe(spark):
    r = random.Random(5)
    rows = [(str(k), r.choice("uvw"), r.choice("st"), r.choice(["x", "y"]), k, 0) for k in range(40)]
    got = dedupe.dedupe_sections(section(spark, rows), contiguous=False).orderBy("page_seq").collect()
    assert [x.doc_id for x in got] == fold(rows)
    rows.sort(key=lambda x: x[1])
    rows = [(*x[:4], k, 0) for k, x in enumerate(rows)]
    for way in (True, False):
        got = dedupe.dedupe_sections(section(spark, rows), contiguous=way).orderBy("page_seq").collect()
        assert [x.doc_id for x in got] == fold(rows)
    marked = {x.doc_id: x.duplicate_of for x in dedupe.with_duplicate_of(section(spark, rows)).collect()}
    assert {d for d, of in marked.items() if of is None} == set(fold(rows))


def test_chunk_dedupe_is_global_and_idempotent(spark):
    rows = [("a", "u", "t", "Same  Text", 0, 0), ("b", "v", "t", "same text", 1, 0), ("c", "v", "t", "other", 1, 1), ("d", "v", "t", None, 2, 0)]
    once = dedupe.dedupe_chunks(section(spark, rows))
    assert sorted(r.doc_id for r in once.collect()) == ["a", "c", "d"] == sorted(r.doc_id for r in dedupe.dedupe_chunks(once).collect())


def test_topk(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, 8))
    v[3] = v[4]
    table = spark.createDataFrame([(k, [float(x) for x in row], k % 2) for k, row in enumerate(v)] + [(900, None, 0), (901, [0.0] * 8, 0)], "id long, embedding array<double>, part int").repartition(5)
    q = table.where("id < 4 OR id = 901").select(F.col("id").alias("query_id"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in (1, 7, 500):
        got = retrieve.topk_cosine(table.where("part = 0"), q, k, exclude_same=True).orderBy("query_id", "rank").collect()
        for i in range(4):
            want = sorted(((-float(unit[i] @ unit[j]), j) for j in range(0, 200, 2) if j != i))[:k]
            mine = [r for r in got if r.query_id == i]
            assert [r.id for r in mine] == [j for _, j in want] and all(abs(r.score + s) < 1e-12 for r, (s, _) in zip(mine, want, strict=True))
        assert not [r for r in got if r.query_id == 901]
    assert retrieve.topk_cosine(table, q.limit(0), 3).count() == 0


def test_topk_passes_over_unsound_vectors(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0], None, [0.0, 0.0], [1e-200, 0.0], [1e200, 0.0]]
    table = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>").coalesce(1)
    q = table.withColumnRenamed("id", "query_id")
    got = retrieve.topk_cosine(table, q, 4).where("query_id = 0").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 9, 10, 1] and {r.query_id for r in retrieve.topk_cosine(table, q, 4).collect()} == {0, 1, 2, 9, 10}


def test_records_of_hits_only(spark):
    """An index of vectors finds what the whole index finds, and asks for the records of its hits alone."""
    kind = "id string, document string, embedding array<double>, metadata struct<content_type:string,program_type:string>"
    rows = [(str(k), f"text {k}", [1.0, k / 10], ("faq" if k % 2 else "x", "general")) for k in range(40)] + [("7", "the other 7", [0.0, 1.0], ("faq", "general"))]
    whole, asked = spark.createDataFrame(rows, kind), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    seen = []

    def records(hits):
        seen.extend(r.id for r in hits.collect())
        return whole.join(hits.select("id"), "id", "left_semi")

    got = retrieve.search(whole.select("id", "embedding"), asked, 3, records=records)
    want = retrieve.search(whole, asked, 3)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert sorted(seen) == ["0", "1", "2", "38", "39", "7"]


HITS = "query_id long, id string, url string, section_title string, score double, document string, question string"


def test_two_stages(spark):
    rows = [(1, "a", "u", "s", 0.9, "red fox", "red fox"), (1, "b", "u", "s", 0.8, "x", "red fox"), (1, "c", "v", None, 0.35, "red", "red fox"), (1, "d", "w", None, None, "none", "red fox"), (1, "e", "x", "s", 0.34, "red fox", "red fox"), (2, "f", "u", "s", 0.1, "z", "q")]
    hits = spark.createDataFrame(rows, HITS)
    distinct, final = retrieve.two_stage(hits, 2)
    assert sorted(r.id for r in distinct.collect()) == ["a", "c", "d", "e", "f"]
    assert [(r.id, r.rerank_score, r.rank) for r in final.orderBy("rank").collect()] == [("a", 1.0, 1), ("c", 0.5, 2)]
    assert [r.id for r in retrieve.two_stage(hits, 3, model=None)[1].orderBy("rank").collect()] == ["a", "c", "d"]


def test_answers(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, None, 1, "The first. Second.", ("http://u", "P", None, "faq"))], "query_id long, id string, score double, rerank_score double, rank int, document string, metadata struct<url:string,page_title:string,section_title:string,content_type:string>")
    questions = spark.createDataFrame([(1, "What?"), (2, "Other?")], "query_id long, question string")
    built = generate.context_and_sources(hits).first()
    assert built.context == "[Source 1]\nURL: http://u\nPage title: P\nSection title: Unknown section\nContent type: faq\n\nThe first. Second." and built.sources[0].source_id == "Source 1"
    out = {r.query_id: r for r in generate.answer(questions, hits, hits).collect()}
    assert out[1].answer == "The first. [Source 1]" and out[1].sources[0].url == "http://u"
    assert out[2].answer == generate.refusal() and out[2].sources == [] and out[2].retrieved is None
    lines = generate.answer(questions, hits, hits).where("query_id = 1").select(generate.source_lines(F.col("sources")).alias("x")).first().x
    assert lines == "[Source 1] null | faq | http://u"
    scored = evaluate.score_answers(generate.answer(questions, hits, hits), spark.createDataFrame([(1, "first thing"), (2, "x")], "query_id long, expected string")).orderBy("query_id").collect()
    assert (scored[0].correctness, scored[0].groundedness, scored[0].retrieval) == (0.5, 1.0, 0.9) and abs(scored[0].final_score - 0.72) < 1e-12 and scored[1].retrieval == 0.0
    judged = evaluate.judged_set(generate.answer(questions, hits, hits), spark.createDataFrame([(1, "ref")], "query_id long, reference string")).first()
    assert judged.contexts == ["The first. Second."] and judged.reference == "ref"


def test_failing_model_fails(spark):
    class Broken:
        def generate(self, system, prompts):
            raise ValueError("out of order")

    hits = spark.createDataFrame([(1, "a", 0.9, None, 1, "d", (None, None, None, None))], "query_id long, id string, score double, rerank_score double, rank int, document string, metadata struct<url:string,page_title:string,section_title:string,content_type:string>")
    with pytest.raises(Exception, match="out of order"):
        generate.answer(spark.createDataFrame([(1, "q")], "query_id long, question string"), hits, hits, Broken).collect()


def test_hit_rate(spark):
    hits = spark.createDataFrame([(1, "Some TEXT", ("faq", "u")), (2, "zzz", ("x", "u"))], "query_id long, document string, metadata struct<content_type:string,url:string>")
    cases = spark.createDataFrame([(1, "faq", ["text", "no"]), (2, "faq", None), (3, None, None), (4, None, ["x"])], "query_id long, expected_content_type string, expected_keywords array<string>")
    got = evaluate.hit_rate(cases.where("query_id <> 4"), hits).orderBy("query_id").collect()
    assert [r.success for r in got] == [True, False, False]
    assert abs(evaluate.accuracy(evaluate.hit_rate(cases, hits)).first().accuracy - 0.25) < 1e-12


def test_index(spark):
    row = ("c1", "d1", "P", "S", "faq", "general", "Text  here", ["a", "b"], [])
    chunks = spark.createDataFrame([row, (None, None, "P", "S", "faq", "general", "no id", None, None)], "chunk_id string, doc_id string, page_title string, section_title string, content_type string, program_type string, content_clean string, keywords array<string>, emails array<string>").withColumn("content", F.lit(""))
    r = index.build_index(chunks).collect()
    assert len(r) == 1 and r[0].id == "c1" and r[0].document == "Page title: P Section title: S Content type: faq Program type: general Text here"
    assert r[0].metadata.keywords == "a, b" and r[0].metadata.emails is None and abs(sum(x * x for x in r[0].embedding) - 1) < 1e-5
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, at int")
    assert sorted(tuple(x) for x in index.upsert(old, new, "at").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    last = spark.createDataFrame([("b", k) for k in range(50)] + [("c", 4)], "id string, v int").repartition(1)
    assert sorted(tuple(x) for x in index.upsert(old, last).collect()) == [("a", 1), ("b", last.where("id = 'b'").collect()[-1].v), ("c", 4)]
    assert [x.tolist() for x in models.HashedWords(4).embed([""])] == [[0.0] * 4]


def test_document_is_worked_out_once(spark):
    chunks = spark.createDataFrame([("c", "d", "P", "S", "faq", "general", "x" * 50, "")], "chunk_id string, doc_id string, page_title string, section_title string, content_type string, program_type string, content_clean string, content string")
    plan = index.build_index(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Page title: ") == 1
    bare = chunks.withColumns({c: F.lit(None).cast("string") for c in ("page_title", "section_title", "content_type", "program_type", "content_clean")})
    assert index.index_records(bare, 54).count() == 1 and index.index_records(bare, 55).count() == 0  # the labels alone


@pytest.mark.parametrize("dims", [64, 7])
def test_hashed_words_like_a_loop(dims):
    import zlib

    texts = ["", " .,- ", "One_two 3 three-four\tFIVE\x00six\x1cseven", "one one ONE", "\u212aelvin k \u0130x \u0661\u0662 \xe9lan E\u0301a na\xefve \u4e2d\u6587 \U0001f600 x\u200by", "".join(map(chr, range(256)))]
    for row, text in zip(models.HashedWords(dims).embed([models.EMBEDDING_PREFIX + t for t in texts]), texts, strict=True):
        want = [0.0] * dims
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            want[h % dims] += 1 if h >> 16 & 1 else -1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert max(abs(a - b / norm) for a, b in zip(row, want, strict=True)) < 1e-6, text


def test_crawl(spark):
    site = {"http://s/1": ["/2", "/3", "/x.pdf", "http://t/9"], "http://s/2": ["/1", "/4", "/5"], "http://s/3": ["/4", "/missing"], "http://s/4": ["/1"], "http://s/5": []}
    pages = spark.createDataFrame([(u, "".join(f"<a href='{h}'>x</a>" for h in hs)) for u, hs in site.items()], "url string, html string")
    walk = lambda most: [r.url for r in crawl.crawl(spark, ["http://s/1/"], crawl.fetch_from(pages), max_pages=most, domains=("s",), path_words=("",)).orderBy("page_seq").collect()]
    assert walk(100) == ["http://s/1", "http://s/2", "http://s/3", "http://s/4", "http://s/5"] and walk(3) == ["http://s/1", "http://s/2", "http://s/3"]
    asked = []
    lookup = crawl.fetch_from(pages)
    found = crawl.crawl(spark, ["http://s/2", "http://s/missing", "http://s/1", "http://s/3"], lambda f: (asked.append(f.count()), lookup(f))[1], max_pages=2, domains=("s",), path_words=("",))
    assert [r.url for r in found.orderBy("page_seq").collect()] == ["http://s/2", "http://s/1"] and asked == [2, 1]
    twice = spark.createDataFrame([("http://s/1/", "b", 2), ("http://s/1#x", "a", 1)], "url string, html string, n long")
    assert [r.html for r in crawl.crawl(spark, ["http://s/1"], crawl.fetch_from(twice, "n")).collect()] == ["a"]


def test_overlap_repeats_last_sentence(spark):
    text = " ".join(f"Sentence number {k} has exactly nine words in it." for k in range(100))
    parts = spark.createDataFrame([(text,)], "x string").select(chunk.chunk_texts("x").alias("y")).first().y
    assert len(parts) > 1 and parts[1].startswith(re.findall(r"Sentence number \d+", parts[0])[-1])
