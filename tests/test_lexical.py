"""BM25, drawn answers and aligned scores against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from lexiloom.operators import dedupe, evaluate, generate, index, lexical, retrieve
from lexiloom.plans.ingest import ask


def words(text):
    return re.findall(r"\w+", (text or "").lower())


DOCUMENTS = [
    ("a", "Fees are due in May. Fees can be paid late. The office is shut in June."),
    ("b", "The office is open in May. Ask the office about fees."),
    ("c", None), ("d", ""), ("e", "fees fees fees fees"), ("f", "Fees are due in May. Fees can be paid late. The office is shut in June."),
]
QUESTIONS = [(1, "When are fees due in May?"), (2, "the office, the OFFICE"), (3, None), (4, "zebra")]


def weights(question):
    have = lambda w: sum(w in words(t) for _, t in DOCUMENTS)
    return {w: math.log(1 + (len(DOCUMENTS) - have(w) + 0.5) / (have(w) + 0.5)) for w in set(words(question))}


def bm25(question, document):
    mean = sum(len(words(t)) for _, t in DOCUMENTS) / len(DOCUMENTS)
    held = words(document)
    return sum(k * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(held) / mean)) for w, k in weights(question).items() if (n := held.count(w)))


def hits(spark):
    made = [(q, i, asked, text, 0.5) for q, asked in QUESTIONS for i, text in DOCUMENTS]
    return spark.createDataFrame(made, "query_id long, id string, question string, document string, score double")


def corpus(spark):
    return lexical.corpus(spark.createDataFrame(DOCUMENTS, "id string, text string"))


def test_bm25(spark):
    got = {(r.query_id, r.id): r.rerank_score for r in lexical.bm25(hits(spark).withColumn("rerank_score", F.lit("x")), corpus(spark)).collect()}
    assert got == {(q, i): round(bm25(asked, text), 9) for q, asked in QUESTIONS for i, text in DOCUMENTS}
    assert got[1, "a"] > got[1, "b"] > got[1, "c"] == 0 == got[3, "a"] == got[4, "a"]
    final = retrieve.best(lexical.bm25(hits(spark), corpus(spark)), 2)
    assert [r.id for r in final.where("query_id = 1").orderBy("rank").collect()] == ["a", "f"]
    assert lexical.bm25(hits(spark).where("false"), corpus(spark)).count() == 0


def drawn(question, final, n=3):
    """Sentences chosen one by one, over all of them."""
    weight = weights(question)
    lines = [(rank, place, s) for rank, text in final for place, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", (text or "").strip()) if x)]
    pool = {x: round(sum(weight[w] for w in set(words(x[2])) if w in weight) / sum(weight.values()), 9) for x in lines} if weight else {}
    left, taken = sorted((-r, *x) for x, r in pool.items() if r > 0)[:20], []
    alike = lambda a, b: len(a & b) / len(a | b)
    while left and len(taken) < n:
        near = lambda x: max((alike(set(words(x[3])), set(words(t[3]))) for t in taken), default=0)
        best = min(left, key=lambda x: (-round(0.7 * -x[0] - 0.3 * near(x), 9), x[1], x[2]))
        left.remove(best)
        taken.append(best)
    return " ".join(f"{t[3]} [Source {t[1]}]" for t in taken)


def test_extractive_answers(spark):
    known = corpus(spark)
    final = retrieve.best(lexical.bm25(hits(spark), known), 4)
    texts = {q: [(r.rank, r.document) for r in final.where(F.col("query_id") == q).orderBy("rank").collect()] for q, _ in QUESTIONS}
    got = {r.query_id: r.said for r in lexical.extractive_answers(final, known).collect()}
    assert got == {q: drawn(asked, texts[q]) for q, asked in QUESTIONS if drawn(asked, texts[q])}
    assert set(got) == {1, 2} and got[1].startswith("Fees are due in May. [Source 1]") and "[Source 3]" in got[1] + got[2]
    assert evaluate.groundedness(F.lit(got[1])) is not None
    assert lexical.extractive_answers(final.where("false"), known).count() == 0


def test_ask_by_words(spark):
    text = "Fees are due in May every year, whatever the course and the place of study may be."
    row = ("c", "https://x.example/a", "Fees", "Fees", "tuition", "general", text)
    chunks = spark.createDataFrame([row], "chunk_id string, url string, page_title string, section_title string, content_type string, program_type string, content string")
    chunks = chunks.withColumns({"doc_id": F.col("chunk_id"), "content_clean": F.col("content")})
    records = index.build_index(chunks).cache()
    asked = spark.createDataFrame([(1, text), (2, "zebra")], "query_id long, question string")
    got = {r.query_id: r for r in ask(records, asked, corpus=lexical.corpus(records, "document")).collect()}
    assert got[1].answer.endswith("[Source 1]") and "due in May" in got[1].answer and len(got[1].sources) == 1
    assert got[2].answer == generate.refusal() and not got[2].sources


def aligned(question, answer, contexts, reference):
    sets = lambda t: [set(words(s)) for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", t or "") if words(s)]
    covered = lambda s, by: max((len(s & b) / len(s) for b in by), default=0)
    asked, said, given, wanted = sets(question), sets(answer), [sets(c) for c in contexts or []], sets(reference)
    borne = [covered(a, sum(given, [])) >= 0.5 for a in said]
    good = [any(covered(r, c) >= 0.5 for r in wanted) for c in given]
    ranks = [sum(good[: k + 1]) / (k + 1) for k, g in enumerate(good) if g]
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    return mean(borne), mean([covered(q, said) for q in asked]), mean(ranks)


def test_aligned_scores(spark):
    r = random.Random(3)
    line = lambda: " ".join(" ".join(r.choices(["Red", "blue", "is", "a", "tone", "hue"], k=r.randint(1, 4))).capitalize() + "." for _ in range(r.randint(0, 3)))
    rows = [(line(), line(), [line() for _ in range(r.randint(0, 4))], line()) for _ in range(60)] + [(None, None, None, None), ("!!", "?", [None, ""], "...")]
    got = evaluate.aligned_scores(spark.createDataFrame(rows, "question string, answer string, contexts array<string>, reference string")).collect()
    near = lambda a, b: all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    key = lambda t: (t[0], t[1], None if t[2] is None else tuple(t[2]), t[3])
    want = {key(t): aligned(*t) for t in rows}
    assert len(got) == len(rows) and all(near((g.faithfulness, g.response_relevancy, g.context_precision), want[key(g)]) for g in got)


def test_sections_in_any_order(spark):
    """Many sections of one content, over several ranges: equal to a fold; a null address is one like others."""
    r = random.Random(9)
    rows = [(k, r.choice(["u", "v", "w", None]), r.choice("st"), r.choice(["x", "x", "x", "y"])) for k in range(400)]
    kept, keys, last = [], {}, {}
    for k, u, t, c in rows:
        key = "|".join(x for x in (u, t, c) if x is not None)
        if key in keys.setdefault(c, set()) or (c in last and last[c] == u):
            continue
        keys[c].add(key)
        last[c] = u
        kept.append(k)
    table = spark.createDataFrame(rows, "page_seq long, url string, section_title string, content string").withColumns({"section_seq": F.lit(0), "content_clean": F.col("content")})
    got = dedupe.dedupe_sections(table.repartition(7), contiguous=False)
    assert [x.page_seq for x in got.orderBy("page_seq").collect()] == kept and got.columns == table.columns
    assert dedupe.dedupe_sections(table.where("false"), contiguous=False).count() == 0
