"""Chunking: sentences packed greedily under a token budget, the last ones repeated in the next chunk.

A fold over the counts of each text's sentences, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

MAX_TOKENS = 690


def word_slices(sentence: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """A sentence beyond the budget in slices of words, without overlap."""
    size = max(80, int(max_tokens * 0.55))
    words = F.split(sentence, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words), F.lit(size)), lambda i: F.array_join(F.slice(words, i, size), " "))


def chunk_texts_of_clean(text: Column | str, max_tokens: int = MAX_TOKENS, overlap: int = 1) -> Column:
    """array<string>: the chunks of a clean text. A chunk that begins with a repeated sentence may exceed the budget.

    The fold goes over the sentences' counts alone: its state is where the open chunk begins, what it holds and the
    ends of chunks so far. A chunk's text is put together once, and cleaned again where joining may have made a phrase.
    """
    places = "cast(array() AS array<struct<first:int,n:int>>)"
    place = lambda first, n: F.array(F.struct(first.cast("int").alias("first"), n.cast("int").alias("n")))

    def folded(lexemes: Column) -> Column:
        """(first sentence, number of sentences) of each chunk; 0 sentences: one beyond the budget, to be sliced."""
        begin = F.struct(F.expr(places).alias("done"), F.lit(1).alias("at"), F.lit(1).alias("first"), F.lit(0).alias("n"))

        def step(st: Column, x: Column) -> Column:
            k, at, size = T.tokens_of(x), st["at"], st["at"] - st["first"]
            flushed = F.when(size > 0, F.concat(st["done"], place(st["first"], size))).otherwise(st["done"])
            state = lambda done, first, n: F.struct(done.alias("done"), (at + 1).alias("at"), first.cast("int").alias("first"), n.cast("int").alias("n"))
            over = state(F.concat(flushed, place(at, F.lit(0))), at + 1, F.lit(0))
            back = F.least(size, F.lit(overlap))
            carried = F.when(back > 0, T.tokens_of(F.aggregate(F.slice(lexemes, at - back, back), F.lit(0), lambda a, b: a + b))).otherwise(0)
            new = state(flushed, at - back, carried + k)
            more = state(st["done"], st["first"], st["n"] + k)
            return F.when(k > max_tokens, over).when((size > 0) & (st["n"] + k > max_tokens), new).otherwise(more)

        def finish(st: Column) -> Column:
            size = st["at"] - st["first"]
            return F.when(size > 0, F.concat(st["done"], place(st["first"], size))).otherwise(st["done"])

        return F.aggregate(lexemes, begin, step, finish)

    def of(sentences: Column) -> Column:
        found = T.let(F.transform(sentences, lambda s: T.lexeme_count(s)), folded)
        cut = lambda p: F.when(p["n"] > 0, F.array(F.array_join(F.slice(sentences, p["first"], p["n"]), " "))).otherwise(word_slices(F.get(sentences, p["first"] - 1), max_tokens))
        return F.flatten(F.transform(found, cut))

    chunks = F.transform(T.let(T.sentences_of_clean(text), of), lambda c: F.when(T.holds_junk(c), T.clean_text(c)).otherwise(F.trim(c)))
    return F.filter(chunks, lambda c: c != "")


def chunk_texts(text: Column | str, max_tokens: int = MAX_TOKENS, overlap: int = 1) -> Column:
    return chunk_texts_of_clean(T.clean_text(text), max_tokens, overlap)


def chunk_sections(sections: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = 1) -> DataFrame:
    """Sections within the budget as they are, others as chunks that inherit their labels."""
    text = F.coalesce(F.nullif("content_clean", F.lit("")), F.col("content"))
    cut = lambda t: chunk_texts_of_clean(t, max_tokens, overlap)
    parts = F.when(F.col("token_count") > max_tokens, T.let(T.clean_text(text), cut)).otherwise(F.expr("cast(array() AS array<string>)"))
    rows = sections.withColumn("_parts", parts).select("*", F.posexplode_outer("_parts").alias("_i", "_text"))
    is_part = F.col("_text").isNotNull()
    chunk_id = T.sha256(F.lower(F.concat_ws("|", "doc_id", F.lit("chunk"), F.col("_i").cast("string"), "_text")))
    new = {
        "doc_id": chunk_id, "parent_doc_id": F.col("doc_id"), "chunk_id": chunk_id, "chunk_index": F.col("_i"), "chunk_count": F.size("_parts"),
        "content": F.col("_text"), "content_clean": T.clean_text("_text"), "content_summary": T.summary("_text"), "token_count": T.token_count("_text"),
        "char_count": F.length("_text"), "is_chunk": F.lit(True),
    }
    whole = {"chunk_id": F.col("doc_id"), "chunk_index": F.lit(0), "chunk_count": F.lit(1), "is_chunk": F.lit(False)}
    columns = [F.when(is_part, new[c]).otherwise(whole.get(c, F.col(c))).alias(c) if c in new else F.col(c) for c in sections.columns]
    return rows.select(*columns)
