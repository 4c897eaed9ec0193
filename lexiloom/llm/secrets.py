"""Secret scans in DataFrame expressions.

Known forms are found by pattern. Beyond these, a window slides over every candidate string; its
Shannon entropy is kept up by incremental counts (one character enters, one leaves) and judged by
the window's character class. Windows over the threshold are merged into spans; candidates on an
allow-list add none.

Places come from splitting a text at its matches: the lengths of what lies between and of the
matches add up to code-point offsets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import text as X
from .text import let, masked

# The forms of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character from which on a window counts, by character class.
HEX_BITS, BASE64_BITS = 3.0, 3.75
#: Candidates that are known not to be secret. Repeated groups are possessive: others recurse once for each repetition.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUIDs
    r"EXAMPLE(KEY)?$",  # sample keys of documentation
    r"^(?:[-_/+=]*+(?:[A-Z]*+[a-z]{2,}+|[A-Z]++(?![a-z])|[a-z](?![A-Za-z])))++[-_/+=]*+$",  # words, written as words, capitalised, joined or in capitals
    r"^[0-9+/_=-]+$",  # numbers, dates, rules
)
#: Positions of a candidate that one fold goes over.
_RUN = 4096

_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _none(kind: str = _SPANS) -> Column:
    return F.expr(f"cast(array() AS {kind})")


def _located(text: Column, found: Column, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, m>> for the matches ``found`` of the pattern, those that are ``good``; code points, end exclusive."""
    pairs = F.zip_with(F.slice(F.split(text, F.lit(pattern), -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def placed(x: Column) -> Column:
        before = X.running(F.transform(x, lambda p: p["gap"] + p["n"]))
        return F.zip_with(x, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("end"), p["m"].alias("m")))

    all_of = let(pairs, placed)
    fine = F.size(found) > 0 if good is None else F.exists(found, good)
    return F.when(fine, all_of if good is None else F.filter(all_of, lambda p: good(p["m"]))).otherwise(_none("array<struct<start:int,end:int,m:string>>"))


def _merged(spans: Column, rank: int) -> Column:
    """Windows in order of their starts, those that touch made one."""

    def of(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(s, i - 1)["end"]))
        last = lambda h, j: F.get(s, F.coalesce(F.get(h, j + 1), F.size(s)) - 1)
        one = lambda h: F.transform(h, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.lit(rank).alias("rank"), last(h, j)["end"].alias("end")))
        return F.when(F.size(s) > 0, let(heads, one)).otherwise(_none())

    return let(spans, of)


def dense_windows(candidate: Column, at: Column, rank: int) -> Column:
    """Spans of ``candidate``, which starts at ``at``: windows of high entropy for their class, merged.

    The state has the counts of the window's characters and the sum of c log c over them, whence
    entropy = log W - sum / W; and the counts of capitals, small letters, digits and characters beyond hex digits. A
    window has letters and digits, or letters of both cases. A candidate is gone over in runs, each of which starts
    a window early, so a fold's state stays small however long the candidate is.
    """
    grow = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    limit = lambda bits: F.lit(WINDOW * (math.log2(WINDOW) - bits) + 1e-9)
    zero = F.lit(0)
    between = lambda c, lo, hi: ((c >= ord(lo)) & (c <= ord(hi))).cast("int")
    upper, lower, digit = (lambda c: between(c, "A", "Z")), (lambda c: between(c, "a", "z")), (lambda c: between(c, "0", "9"))
    beyond = lambda c: 1 - between(c, "0", "9") - between(c, "A", "F") - between(c, "a", "f")
    kinds = {"upper": upper, "lower": lower, "digits": digit, "beyond": beyond}
    begin = F.struct(F.array_repeat(zero, 128).alias("counts"), F.lit(0.0).alias("sum"), *(zero.alias(k) for k in kinds), _none().alias("spans"))

    def step(first: Column, s: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        n_old = F.get(s["counts"], old)
        n_new = F.get(s["counts"], new) - F.coalesce((new == old).cast("int"), zero)
        total = s["sum"] + F.get(grow, n_new + 1) - F.get(grow, n_new) - F.coalesce(F.get(grow, n_old) - F.get(grow, n_old - 1), F.lit(0.0))
        counts = F.transform(s["counts"], lambda c, j: c + (j == new).cast("int") - F.coalesce((j == old).cast("int"), zero))
        n = {k: s[k] + f(new) - F.coalesce(f(old), zero) for k, f in kinds.items()}
        mixed = (n["digits"] > 0) & (n["upper"] + n["lower"] > 0) & (total <= F.when(n["beyond"] == 0, limit(HEX_BITS)).otherwise(limit(BASE64_BITS)))
        cased = (n["upper"] > 0) & (n["lower"] > 0) & (total <= limit(BASE64_BITS))
        dense = (x["i"] >= first) & (x["i"] >= WINDOW - 1) & (mixed | cased)
        start, end = at + x["i"] - (WINDOW - 1), at + x["i"] + 1
        last = F.get(s["spans"], F.size(s["spans"]) - 1)
        joins = F.coalesce(last["end"] >= start, F.lit(False))
        one = lambda begin: F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        more = F.when(joins, F.concat(F.slice(s["spans"], 1, F.greatest(F.size(s["spans"]) - 1, zero)), one(last["start"]))).otherwise(F.concat(s["spans"], one(start)))
        return F.struct(counts.alias("counts"), total.alias("sum"), *(v.alias(k) for k, v in n.items()), F.when(dense, more).otherwise(s["spans"]).alias("spans"))

    def run(chars: Column, k: Column) -> Column:
        from_ = F.greatest(k * _RUN - (WINDOW - 1), zero)
        part = F.slice(chars, from_ + 1, (k + 1) * _RUN - from_)
        steps = let(part, lambda p: F.transform(p, lambda c, j: F.struct(c.alias("new"), F.get(p, j - WINDOW).alias("old"), (from_ + j).alias("i"))))
        return F.aggregate(steps, begin, lambda s, x: step(k * _RUN, s, x))["spans"]

    chars = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    runs = let(chars, lambda c: F.transform(F.sequence(zero, F.floor((F.size(c) - 1) / _RUN).cast("int")), lambda k: run(c, k)))
    return _merged(F.flatten(runs), rank)


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with a column secrets: array<struct<kind, start, end>>, by start, then kind as in ``KINDS``.

    Whole texts are searched; a null text counts as empty and has none. Spans are code points, end
    exclusive. Spans of kind entropy that lie within another kind's are left out; the allow-list
    bears on that kind alone. Nothing is shuffled: rows stay as they are, whatever other columns
    there are, and a column named secrets is replaced.
    """
    text = X.whole(F.col("doc.text"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = rows.select("doc", all_of(ASSIGN).alias("assign"), all_of(ACCESS).alias("access"), all_of(HEX).alias("hex"), all_of(CANDIDATE).alias("candidate"))
    suspect = (lambda m: ~F.array_contains(F.array(*(m.rlike(a) for a in allowed)), True)) if allowed else None
    ranked = lambda places, rank: F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end")))
    rows = rows.select(
        "doc",
        F.concat(
            ranked(_located(text, F.col("assign"), ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12), 0),
            ranked(_located(text, F.col("access"), ACCESS), 1),
            ranked(_located(text, F.col("hex"), HEX), 2),
        ).alias("known"),
        _located(text, F.col("candidate"), CANDIDATE, suspect).alias("places"),
    )
    dense = F.flatten(F.transform("places", lambda p: dense_windows(p["m"], p["start"], 3)))
    fresh = F.filter(dense, lambda d: ~F.exists("known", lambda k: (k["start"] <= d["start"]) & (k["end"] >= d["end"])))
    found = F.concat("known", F.when(F.size("places") > 0, fresh).otherwise(_none()))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform(F.array_sort(found), lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc.*", named.alias("secrets")) if "secrets" not in docs.columns else rows.select("doc", named.alias("secrets")).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns if c != "secrets"), "secrets")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; secrets that overlap make one place."""
    found = find_secrets(docs, **options)
    return found.withColumn("text", masked(F.col("text"), F.col("secrets"), lambda _: F.lit(mask)))
