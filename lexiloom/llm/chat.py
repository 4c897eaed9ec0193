"""Chat formatting as relational expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become
one message; the messages are concatenated into one string with a loss mask over assistant texts.

    <|start|>ROLE<|text|>TEXT<|part|>TEXT<|end|>\\n

``<|part|>`` divides turns that were merged, so the turns can be read back. No text or role can
hold a mark: in them a backslash is put before each backslash and before each ``|`` that follows
``<``. :func:`read_back` takes both steps back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text as X

START, TEXT, PART, END = "<|start|>", "<|text|>", "<|part|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|(?<=<)\|)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _mark(mark: str) -> Column:
    """A pattern for the mark."""
    return F.lit(mark.replace("|", r"\|"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start, end>>, n_messages) for ``turns`` (conv_id, turn, role, text).

    Turns are sorted by turn (null first), then role and text; a null role or text counts as empty.
    Repeated rows stay, as turns of their own. Rows with a null conv_id make up one conversation. An
    empty table gives no row. Other columns, whatever their names, are not read.
    The mask's spans are code points of ``formatted``, end exclusive, one for each text of ``loss_role``.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    chats = chats.withColumn("starts", starts)
    upto = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
    merged = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.transform(F.slice("turns", s, upto(k) - s), lambda t: escaped(t["text"])).alias("parts"),
        ),
    )
    chats = chats.select("conv_id", merged.alias("messages"))
    written = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(START), escaped(m["role"]), F.lit(TEXT), F.array_join(m["parts"], PART), F.lit(END)).alias("string"),
            (m["role"] == loss_role).alias("loss"),
            (F.length(escaped(m["role"])) + len(START + TEXT)).alias("head"),
            F.transform(m["parts"], F.length).alias("lengths"),
        ),
    )
    chats = chats.select("conv_id", written.alias("messages"))
    parts = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["lengths"],
                lambda n, j: F.struct(
                    m["loss"].alias("loss"),
                    F.when(j == 0, m["head"]).otherwise(len(PART)).alias("before"),
                    n.alias("length"),
                    F.when(j == F.size(m["lengths"]) - 1, len(END)).otherwise(0).alias("after"),
                ),
            ),
        )
    )

    def placed(x: Column) -> Column:
        at = X.running(F.transform(x, lambda p: p["before"] + p["length"] + p["after"]))
        start = lambda p, t: t + p["before"]
        each = F.zip_with(x, at, lambda p, t: F.struct(p["loss"].alias("loss"), start(p, t).alias("start"), (start(p, t) + p["length"]).alias("end")))
        return F.transform(F.filter(each, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    return chats.select(
        "conv_id",
        F.array_join(F.transform("messages", lambda m: m["string"]), "").alias("formatted"),
        X.let(parts, placed).alias("loss_mask"),
        F.size("messages").cast("long").alias("n_messages"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds, unescaped."""
    halves = F.transform(F.filter(F.split(formatted, _mark(END)), lambda m: m != ""), lambda m: F.split(m, _mark(TEXT)))
    messages = F.transform(halves, lambda h: F.struct(unescaped(F.substr(h[0], F.lit(len(START) + 1))).alias("role"), F.split(h[1], _mark(PART)).alias("parts")))
    return F.flatten(F.transform(messages, lambda m: F.transform(m["parts"], lambda t: F.struct(m["role"].alias("role"), unescaped(t).alias("text")))))


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(X.substrings(formatted, mask, unescaped), "")
