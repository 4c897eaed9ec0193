"""Awkward tables that every operator must take: nulls, empties, ties, repeats, extra and clashing columns, long texts."""

from pyspark.sql import functions as F

ODD = [
    (1, None), (2, ""), (3, "  \t "), (4, "one"), (5, "one two three"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"),
    (8, "A  b\tc d e f g h i j"), (None, "a b c d e f g h i j"), (None, None), (9, "é😀 ñ " * 30), (10, "long words here and there. " * 9000), (11, "x" * 60000),
]


def odd_documents(spark):
    df = spark.createDataFrame([(i, t, None if i == 4 else f"s{(i or 0) % 3}") for i, t in ODD], "doc_id long, text string, source string")
    names = ("row", "name", "h", "n", "content", "doc", "key", "node", "secrets", "_key", "spans", "level")
    return df.withColumns({c: F.lit("clash") for c in names}).repartition(3)


def no_documents(spark):
    return odd_documents(spark).where("false")
