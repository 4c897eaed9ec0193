"""The text kernel: Column to Column, in the JVM. White space and word characters are Unicode's."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from . import rules

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_LEXEME = r"(?U)(\w+|[^\w\s\x1c-\x1f])"
_STOP = r"(?<=[.!?])(?U)[\s\x1c-\x1f]+(?-U)(?=[A-Z0-9])"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space become one space, none at either end; null becomes empty."""
    return F.trim(F.regexp_replace(_text(c), _SPACE, " "))


def not_blank(c: Column | str) -> Column:
    """Whether anything is left of a text by ``normalize_whitespace``: it is read up to its first letter only."""
    return F.rlike(_text(c), F.lit(r"(?U)[^\s\x1c-\x1f]"))


def _translated(c: Column, made: Column, old: str, new: str) -> Column:
    """``made``, which has no letters of ``old`` where ``c`` is of one byte a letter, translated; that goes letter by letter, so ASCII is passed by."""
    return F.when(F.octet_length(c) == F.length(c), made).otherwise(F.translate(made, old, new))


def _small(c: Column) -> Column:
    """In lower case, with the letters that a pattern without regard to case takes for s, k and i as such."""
    return _translated(c, F.lower(c), "\u017f\u212a\u0131\u0130\u0307", "skii")


def _without(c: Column, junk: Sequence[str]) -> Column:
    """The phrases deleted one after the other, each only where the text may hold it: a pattern without regard to case is slow."""

    def one(phrase: str) -> Callable[[Column], Column]:
        return lambda t: F.when(_small(t).contains(phrase.lower()), F.regexp_replace(t, rf"(?iuU)\b{phrase}\b", "")).otherwise(t)

    out = c
    for phrase in junk:
        out = let(out, one(phrase))
    return out


def clean_text(c: Column | str, junk: Sequence[str] = rules.UI_JUNK) -> Column:
    """White space normalised, zero-width spaces and phrases of the user interface deleted."""
    spaced = lambda t: normalize_whitespace(_without(t, junk))
    return let(_spaced(c), lambda t: F.when(holds_junk(t, junk), spaced(t)).otherwise(t)) if junk else _spaced(c)


def _spaced(c: Column | str) -> Column:
    """White space normalised, zero-width spaces deleted."""
    return normalize_whitespace(let(_text(c), lambda t: _translated(t, t, "\u00a0\u200b", " ")))


def cleaned_again(c: Column | str, junk: Sequence[str] = rules.UI_JUNK) -> Column:
    """A struct of the text clean, once, and that cleaned again, again: these differ only where a phrase was deleted."""
    once = lambda t: F.struct(t.alias("once"), t.alias("again"))
    twice = lambda t: let(normalize_whitespace(_without(t, junk)), lambda x: F.struct(x.alias("once"), clean_text(x, junk).alias("again")))
    return let(_spaced(c), lambda t: F.when(holds_junk(t, junk), twice(t)).otherwise(once(t)))


def holds_junk(c: Column, junk: Sequence[str] = rules.UI_JUNK) -> Column:
    """Whether a text may hold one of the phrases. False only where none can match."""
    return let(_small(c), lambda t: reduce(or_, (t.contains(p.lower()) for p in junk)))


def sha256(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def lexeme_count(c: Column | str) -> Column:
    """Words and punctuation marks."""
    return F.regexp_count(_text(c), F.lit(_LEXEME))


def tokens_of(lexemes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(lexemes / 0.75).cast("int"))


def token_count(c: Column | str) -> Column:
    """Words and punctuation marks, by 4/3, rounded down; 1 at least."""
    return tokens_of(lexeme_count(c))


def sentences_of_clean(c: Column | str) -> Column:
    """Sentences of a text that is already clean."""
    return F.filter(F.transform(F.split(_text(c), _STOP), lambda s: F.trim(s)), lambda s: s != "")


def split_sentences(c: Column | str) -> Column:
    """A sentence ends at . ! or ? before white space and an ASCII capital or digit."""
    return sentences_of_clean(clean_text(c))


def summary_of_clean(c: Column | str, max_chars: int = 420) -> Column:
    first = let(sentences_of_clean(c), lambda ss: F.when(F.size(ss) > 0, F.array_join(F.slice(ss, 1, 2), " ")))
    return F.rtrim(F.substring(F.coalesce(first, _text(c)), 1, max_chars))


def summary(c: Column | str, max_chars: int = 420) -> Column:
    """The first two sentences, cut to a length."""
    return let(clean_text(c), lambda t: summary_of_clean(t, max_chars))


def bullets(c: Column | str, least: int = 8, most: int = 220, limit: int = 12) -> Column:
    """Distinct lines of a listable length, marks stripped; the length is taken before cleaning."""
    lines = F.transform(F.split(_text(c), r"[\n\r]+"), lambda x: F.regexp_replace(x, r"^[ \-•\t]+|[ \-•\t]+$", ""))
    return F.slice(F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x).between(least, most)), lambda x: clean_text(x))), 1, limit)


def _keyword_candidates(c: Column | str, stopwords: Sequence[str]) -> Column:
    words = F.transform(F.regexp_extract_all(_text(c), F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stopwords))


def keywords(c: Column | str, limit: int = 18, stopwords: Sequence[str] = rules.STOPWORDS) -> Column:
    """The most frequent words, ties by code point: runs of equal words, once they are sorted."""

    def counted(words: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        run = lambda h: F.transform(h, lambda i, j: F.struct((i - F.coalesce(F.get(h, j + 1), F.size(words))).alias("n"), F.get(words, i).alias("w")))
        return F.when(F.size(words) > 0, let(heads, run)).otherwise(F.expr("cast(array() AS array<struct<n:int,w:string>>)"))

    ranked = F.array_sort(let(F.array_sort(_keyword_candidates(c, stopwords)), counted))
    return F.transform(F.slice(ranked, 1, limit), lambda x: x["w"])


def keyword_rows(df: DataFrame, key: str, text: str, limit: int = 18, stopwords: Sequence[str] = rules.STOPWORDS) -> DataFrame:
    """(key, word, n, rank): the keywords of each row, counted by a shuffle with partial counts."""
    from pyspark.sql import Window

    words = df.select(key, F.explode(_keyword_candidates(text, stopwords)).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def _found(c: Column | str, pattern: str, flags: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(f"(?{flags}){pattern}"), F.lit(0)))


def emails(c: Column | str) -> Column:
    return _found(c, rules.EMAIL_PATTERN, "U")


def dates(c: Column | str) -> Column:
    return _found(c, rules.DATE_PATTERN, "iuU")


def money(c: Column | str) -> Column:
    return _found(c, rules.MONEY_PATTERN, "U")


def course_names(c: Column | str, names: Sequence[str] = rules.COURSE_NAMES) -> Column:
    """Case-sensitive; of alternatives that start alike the first in the list wins."""
    return _found(c, rf"\b(?:{'|'.join(names)})\b", "U")


def titlecase(c: Column | str, limit: int = 25) -> Column:
    """Runs of two to five capitalised words."""
    return F.slice(_found(c, rules.TITLECASE_PATTERN, "U"), 1, limit)
