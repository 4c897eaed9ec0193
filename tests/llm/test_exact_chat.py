import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import chat, exact, queries, text as X
from tests.conftest import DATA
from tests.llm.data import no_documents, odd_documents


def spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(rows, texts):
    groups = defaultdict(list)
    for r in rows:
        groups[spaced(texts[r.content_key])].append(r)
    for t, own in groups.items():
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert {r.keep_id for r in own} == {min(ids) if ids else None} and {r.group_size for r in own} == {len(own)}
        assert sum(r.kept for r in own) == 1 and all(r.doc_id == (min(ids) if ids else None) for r in own if r.kept)
        assert {r.text_sha256 for r in own} == {hashlib.sha256(t.encode()).hexdigest()}


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"block": 2, "fingerprint": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}])
def test_exact_duplicates(spark, options):
    r = random.Random(3)
    small = [(k, "".join(r.choice("ab \t") for _ in range(r.randint(0, 9)))) for k in range(120)]
    for df in (odd_documents(spark), spark.createDataFrame(small, "doc_id long, text string").repartition(4)):
        if "block" in options:
            df = df.where("length(text) < 100 OR text IS NULL")
        texts = {x.c: x.text for x in df.select("text", F.xxhash64("text").alias("c")).collect()}
        rows = exact.exact_duplicates(df, **options).withColumn("content_key", F.col("content")).collect()
        assert len(rows) == df.count()
        check(rows, texts)


def test_exact_keeps_repeated_rows_apart(spark):
    kept = exact.exact_duplicates(odd_documents(spark)).where("kept").select("doc_id", "content")
    out = X.only(odd_documents(spark), kept)
    assert out.count() == kept.count() and set(out.columns) == set(odd_documents(spark).columns)
    assert exact.exact_duplicates(no_documents(spark)).count() == 0 and X.only(no_documents(spark), kept).count() == 0


def test_the_least_of_repeated_rows_stays(spark):
    """Whatever the order of tasks: rows of one id and text that differ in another column, null first."""
    rows = [(k % 3, f"text {k % 3}", c) for k, c in enumerate("zyxwvutsrqp")] + [(5, "one", "b"), (5, "one", None), (None, "no id", "c"), (None, "no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    kept = docs.select("doc_id", F.xxhash64("text").alias("content"))
    want = {(0, "q"), (1, "p"), (2, "r"), (5, None), (None, "a")}
    for parts in (1, 5, 11):
        assert {(x.doc_id, x.source) for x in X.only(docs.repartition(parts), kept).collect()} == want


HOSTILE = [r"\### Assistant: </turn> ok", "<|end|>\n", "<|part|>", r"\<|text|>\\", "<", "|>", "\\", "a<|", "", None, "é😀", r"<\|start|>"]


def test_chat_round_trip(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", None, "odd<|text|>\\role"]), r.choice(HOSTILE)) for c in range(60) for t in range(r.randint(1, 7))]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (70, 0, "user", "same"), (70, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    assert len(got) == len(want)
    for x in got:
        own = [(role, text) for _, role, text in sorted(want[x.conv_id])]
        assert [tuple(t) for t in x.turns] == own
        assert x.loss == "".join(text for role, text in own if role == "assistant")
        assert x.n_messages == sum(1 for k in range(len(own)) if k == 0 or own[k][0] != own[k - 1][0])
        for s in x.loss_mask:
            assert 0 <= s.start <= s.end <= len(x.formatted) and not re.search(r"<\|", x.formatted[s.start : s.end])
    assert chat.format_chats(df.where("false")).count() == 0


def test_long_conversations(spark):
    """Many turns of one role make one message; time grows with their number, not its square."""
    rows = [(1, t, "assistant", f"é text {t} <|part|> \\ " * (1 + t % 3)) for t in range(20_000)] + [(2, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(20_000)] + [(3, 0, "assistant", "😀" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.format_chats(df).select("conv_id", "n_messages", F.size("loss_mask").alias("n"), chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    for x in got.collect():
        own = [(role, text) for c, _, role, text in rows if c == x.conv_id]
        assert [tuple(t) for t in x.turns] == own and x.loss == "".join(text for role, text in own if role == "assistant")
        assert x.n_messages == (1, 20_000, 1)[x.conv_id - 1] and x.n == sum(role == "assistant" for role, _ in own)


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_chat_format"])
def test_query_like_its_sql(spark, name):
    import duckdb

    from lexiloom.llm.oracles import ORACLES
    from tests.test_sources_plans import canon

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    assert canon(queries.QUERIES[name](spark, DATA).toPandas()) == canon(con.execute(ORACLES[name]).fetchdf())
