import re

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import rules, text as T
from tests.page_loops import clean

SAMPLES = [
    None, "", "a b​c\u001cd  e\n\tf ", "Éa élan naïve 😀 x", "Learn Learn More More now", "read MORE. Back to Top! apply today", "Loading…x and Loading… y",
    "It cost $1,200.50 and $ 5 on June 23, 2026 or 1/2/26, Autumn 2026.", "one. Two? three! 4 five. Élan. Six", "me.too+x@a-b.co.uk, é@ñ.org x@y",
    "- one bullet\n•  two bullets here\n\t1234567\n12345678\n" + "x" * 220 + "\n" + "y" * 221 + "\n- one bullet", "New York City Hall and San Francisco and Élan Vital",
    "Machine Learning II, Machine Learning Operations, Generative AI: the basics of it. Time Series Analysis and Forecasting",
]


def count(x):
    """Four tokens for three lexemes, which are runs of word characters and single marks."""
    n, inside = 0, False
    for c in x or "":
        word = c.isalnum() or c == "_"
        n += not c.isspace() and not (word and inside)
        inside = word
    return n * 4 // 3 or 1


def sentences(x):
    """Words in turn; a sentence ends with a word that closes with a mark, if the next begins with a capital or digit."""
    out, words = [], clean(x).split(" ")
    for k, word in enumerate(words):
        if k and words[k - 1][-1:] in tuple(".!?") and word[:1].isascii() and (word[:1].isupper() or word[:1].isdigit()):
            out.append(word)
        elif out:
            out[-1] += " " + word
        else:
            out = [word]
    return [s for s in out if s]


def unique(xs):
    return list(dict.fromkeys(xs))


def bullets(x):
    lines = [line.strip(" -•\t") for line in re.split(r"[\n\r]+", x or "")]
    return unique(clean(line) for line in lines if 8 <= len(line) <= 220)[:12]


def keywords(x, k=18):
    words = [w for w in (w.lower() for w in re.findall(r"[A-Za-z][A-Za-z\-]{2,}", x or "")) if len(w) > 3 and w not in rules.STOPWORDS]
    return sorted(set(words), key=lambda w: (-words.count(w), w))[:k]


def found(p, flags=0):
    return lambda x: unique(re.findall(p, x or "", flags))


CASES = {
    "clean": (T.clean_text, clean), "count": (T.token_count, count), "sentences": (T.split_sentences, sentences),
    "summary": (T.summary, lambda x: (" ".join(sentences(x)[:2]) or clean(x))[:420].rstrip()), "bullets": (T.bullets, bullets), "keywords": (T.keywords, keywords),
    "emails": (T.emails, found(rules.EMAIL_PATTERN)), "dates": (T.dates, found(rules.DATE_PATTERN, re.I)), "money": (T.money, found(rules.MONEY_PATTERN)),
    "courses": (T.course_names, found(rf"\b(?:{'|'.join(rules.COURSE_NAMES)})\b")), "titlecase": (T.titlecase, lambda x: found(rules.TITLECASE_PATTERN)(x)[:25]),
}


@pytest.mark.parametrize("name", CASES)
def test_like_plain_python(spark, name):
    make, plain = CASES[name]
    texts = SAMPLES + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    for r in df.select("k", make(F.col("x")).alias("y")).collect():
        assert r.y == plain(texts[r.k]), texts[r.k][:200]


def test_token_budget_edges(one):
    assert [one(T.token_count, " ".join(["w"] * n)) for n in (518, 519)] == [690, 692]


def test_keyword_rows(spark):
    texts = ["beta beta alpha alpha gamma the data", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    rows = T.keyword_rows(df, "k", "x").orderBy("k", "rank").collect()
    assert [(r.word, r.n) for r in rows] == [("alpha", 2), ("beta", 2), ("gamma", 1)]


def test_sha(one):
    import hashlib

    assert one(T.sha256, "é") == hashlib.sha256("é".encode()).hexdigest()


def test_not_blank_like_normalized(spark):
    texts = [None, "", *map(chr, range(0xD800)), *map(chr, range(0xE000, 0x10100)), " \t\x1c\xa0\u3000", "\u2003\u2003x", " \u200b", "\n\U0001f600"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert rows.where(T.not_blank("x") != (F.length(T.normalize_whitespace("x")) > 0)).count() == 0 and rows.where(T.not_blank("x").isNull()).count() == 0
