"""Mixing sources to target weights by a splitting tree.

Targets come from weights, with a ceiling on how often a source may repeat. Whole epochs are taken
as they are; the exact rest of a source's target, in words, is split over output shards by a tree
of hypergeometric draws, the marginals of one multivariate-hypergeometric draw over the shards.
Each shard then permutes its own documents of a source and draws words from the front until its quota is met,
so shards work apart, their draws are disjoint and their quotas add up exactly. Last, each shard
shuffles all its copies, whatever their source.

Sources, shards and nodes of the tree are rows of tables: nothing that grows with the input comes to
the driver. Shards, permutations and tree are functions of the rows and the seed, so reruns agree
however the table is laid out in files. (Of rows that repeat more than ``rows_per_shard`` times, which are
spread by their position, it is only left open which of the repeats is taken.)
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as X
from .store import saved

#: Children of a node that are dealt to in one task, by a binary tree of draws.
FAN = 4096


def _ln_factorial(n: int) -> Decimal:
    if n < 64:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    tail = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return x * x.ln() - x + (2 * x * Decimal("3.14159265358979323846264338327950288420")).ln() / 2 + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` things, without putting back, are good. For numbers of any size.

    Few draws are made one by one. Else by rejection from a ratio of uniforms (Stadlober's table
    mountain hat), the probabilities by 40-digit log factorials, so that they hold for 10^15 things too.
    """
    n = good + bad
    few = min(draws, n - draws)
    if not few or not good or not bad:
        return min(good, draws)
    less, more = sorted((good, bad))
    if few < 10:
        hit = 0
        for k in range(few):
            hit += int(rng.integers(n - k)) < less - hit
    else:
        share = less / n
        spread = math.sqrt((n - few) * few * share * (1 - share) / (n - 1) + 0.5)
        hat = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        with localcontext(prec=40):
            ln = lambda k: _ln_factorial(k) + _ln_factorial(less - k) + _ln_factorial(few - k) + _ln_factorial(more - few + k)
            mode = ln((few + 1) * (less + 1) // (n + 2))
            while True:
                u, v = 1 - rng.random(), rng.random()
                at = few * share + 0.5 + hat * (v - 0.5) / u
                if 0 <= at < min(few, less) + 1 and 2 * math.log(u) <= float(mode - ln(int(at))):
                    hit = int(at)
                    break
    of_good = hit if good == less else few - hit
    return of_good if few == draws else good - of_good


def split_quota(sizes: Sequence[int], quota: int, seed: Sequence[int]) -> list[int]:
    """The quota dealt to shards of these sizes: halves of the shards, again and again."""
    sums = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=object))])
    out = [0] * len(sizes)
    todo = [(0, len(sizes), int(quota))] if sizes else []
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        left = hypergeometric(rng, int(sums[mid] - sums[lo]), int(sums[hi] - sums[mid]), q)
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with k, their place by code point, null last: numbers within sorted partitions and the partitions' sizes."""
    order = F.col("source").asc_nulls_last()
    placed = saved(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("in_part"))
    first = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    firsts = sizes.select(F.col("part").alias("_part"), first.alias("first"))
    return placed.join(firsts, part == F.col("_part")).select(*sources.columns, (F.col("first") + F.col("at") - F.shiftleft("_part", 33)).alias("k"))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, size) with k and target: shares of ``share`` times all sizes by weight.

    Weights follow k in turn. What exceeds ``most`` times a source's size is shared anew by weight. Rounds
    are aggregates: a round caps the sources that the last one's unit of weight would overfill.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = saved(_numbered(sources).withColumn("weight", w))
    over, unit, n_over = F.lit(False), 0.0, -1
    while True:
        now = rows.agg(
            F.sum("size").alias("all"), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"), F.count(F.when(over, 1)).alias("n_over"),
        ).first()
        if now.n_over == n_over or not now.free:
            break
        n_over, unit = now.n_over, (share * (now.all or 0) - most * now.capped) / now.free
        over = F.lit(unit) * F.col("weight") > most * F.col("size")
    return rows.withColumn("target", F.when(over, most * F.col("size").cast("double")).otherwise(F.lit(unit) * F.col("weight"))).drop("weight")


def _dealer(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For the children of one node (k, parent, node, size, quota): each one's share of the quota."""

    def dealt(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        k, parent, quota = (int(nodes[c].iloc[0]) for c in ("k", "parent", "quota"))
        return pd.DataFrame({"k": nodes["k"], "node": nodes["node"], "share": split_quota([int(x) for x in nodes["size"]], quota, [seed, k, level, parent])})

    return dealt


def _quotas(leaves: DataFrame, plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(k, shard, share): each source's quota split over its ``leaves`` (k, shard, size), level by level from the top."""
    levels, nodes = [saved(leaves.withColumnRenamed("shard", "node"))], shards
    while nodes > FAN:
        levels.append(levels[-1].groupBy("k", F.expr(f"node div {FAN}").cast("int").alias("node")).agg(F.sum("size").alias("size")))
        nodes = -(-nodes // FAN)
    above = plan.select("k", F.lit(0).alias("node"), F.col("quota").alias("share"))
    for level in reversed(range(len(levels))):
        parent = F.lit(0) if level == len(levels) - 1 else F.expr(f"node div {FAN}").cast("int")
        own = levels[level].select("k", "node", "size", parent.alias("parent"))
        own = own.join(above.select("k", F.col("node").alias("parent"), F.col("share").alias("quota")), ["k", "parent"])

        above = saved(own.groupBy("k", "parent").applyInPandas(_dealer(seed, level), "k long, node int, share long"))
    return above.withColumnRenamed("node", "shard")


_ROW = "doc_id", "source", "content", "size"


def _drawn(docs: DataFrame, weights: Sequence[float], share: float, most: float, shards: int, rows_per_shard: int, seed: int, whole_rows: bool) -> DataFrame:
    """The rows of ``docs`` by shards, with what is drawn of them; nth tells the rows of a source in a shard apart. One exchange moves them."""
    made = [F.col("doc_id"), F.col("source"), F.xxhash64(X.whole(F.col("text"))).alias("content"), X.word_count(F.col("text")).alias("size")]
    slim = saved(docs.select(*made, F.monotonically_increasing_id().alias("at")))
    n_rows = slim.count()
    while shards * rows_per_shard < n_rows:
        shards *= 2
    plan = source_targets(slim.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    quota = F.least(F.col("size"), F.round(F.col("target") - epochs * F.col("size")).cast("long"))
    plan = saved(plan.select("k", F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", epochs.alias("epochs"), quota.alias("quota")))

    rows = docs.select(*made, F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("at")) if whole_rows else slim
    hashed = lambda what, *of: F.xxhash64(F.lit(seed), F.lit(what), *of)
    often = saved(slim.groupBy(*_ROW).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_shard).select(*(F.col(c).alias(f"_{c}") for c in _ROW)))
    spread = not often.isEmpty()
    if spread and whole_rows:
        rows = saved(rows)

    def placed(rows: DataFrame) -> DataFrame:
        salt = F.lit(0).cast("long")
        if spread:
            rows = rows.join(often.withColumnRenamed("_source", "_named"), F.expr("doc_id <=> _doc_id AND source <=> _named AND content = _content AND size = _size"), "left")
            salt = F.when(F.col("_content").isNotNull(), F.col("at")).otherwise(0)
        own = rows.withColumn("shard", F.pmod(hashed("shard", "doc_id", "content", salt), F.lit(shards)).cast("int")).withColumn("salt", salt)
        return own.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(*_ROW, "salt", "shard", "k", "source_size", "target", "epochs", *["doc"] * ("doc" in rows.columns))

    own = placed(rows)
    # Positions differ between the rows and their slim table: where they matter, the quotas are those of the rows themselves.
    leaves = (own if spread else placed(slim)).groupBy("k", "shard").agg(F.sum("size").alias("size"))
    quotas = _quotas(leaves, plan, shards, seed)
    of_shard = saved(quotas.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("k", "share"))).alias("shares")))
    own = own.repartition("shard").join(of_shard, "shard")
    in_order = Window.partitionBy("k", "shard").orderBy("order", "doc_id", "content", "size", "salt")
    own = own.withColumn("order", hashed("order", "doc_id", "content", "salt"))
    before = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    own = own.withColumn("nth", F.row_number().over(in_order)).withColumn("before", before)
    drawn = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.element_at("shares", F.col("k")) - F.col("before")))
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("drawn") > 0).cast("int")).otherwise(0)
    return own.withColumn("drawn", drawn).withColumn("copies", copies).drop("order", "shares", "before", "salt")


def _in_shard(seed: int) -> list[Column]:
    """The local order of copies: all sources of the shard, and the copies of a document, apart."""
    return [F.xxhash64(F.lit(seed), F.lit("place"), "k", "nth", "copy"), F.col("k"), F.col("nth"), F.col("copy")]


def _each_copy(copies: Column) -> Column:
    return F.when(copies > 0, F.sequence(F.lit(1), copies))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, shards: int = 64, rows_per_shard: int = 20_000, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): what the mix takes of it.

    Columns: doc_id, source, content (hash of the text), size, source_size, target, epochs (whole
    copies), drawn (words from the front, once more), taken, shard, places (of the copies taken in the
    shard's shuffled order, from 1; distinct over all sources of the shard).

    Sources are sorted by code point, null last, and weigh ``weights`` in turn; together they share
    ``share`` times all words, each at most ``most`` times its own. A null or empty text has no
    words and nothing taken. Repeated rows count each. An empty table gives no row. Other columns are not read.
    """
    rows = _drawn(docs, weights, share, most, shards, rows_per_shard, seed, False)
    of_row = ["k", "shard", "nth"]
    rest = ["doc_id", "source", "content", "size", "source_size", "target", "epochs", "drawn"]
    copies = rows.select(*of_row, *rest, F.explode_outer(_each_copy(F.col("copies"))).alias("copy"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.col("copy").isNull(), *_in_shard(seed)))
    copies = copies.withColumn("place", F.when(F.col("copy").isNotNull(), place))
    out = copies.groupBy(*of_row).agg(*(F.first(c).alias(c) for c in rest), F.array_sort(F.collect_list("place")).alias("places"))
    return out.select(*rest, (F.col("epochs") * F.col("size") + F.col("drawn")).alias("taken"), "shard", "places")


def mixed(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2, shards: int = 64, rows_per_shard: int = 20_000, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken, the last of them cut to the words drawn.

    Rows come shard by shard, each in its shuffled order. A cut text keeps its own white space. ``n_chars`` follows
    where ``docs`` has it. Rows without words are not drawn. Other columns, whatever their names, stay as they are.
    """
    rows = _drawn(docs, weights, share, most, shards, rows_per_shard, seed, True).where("copies > 0")
    copies = rows.select("shard", "k", "nth", "doc", "size", "epochs", "drawn", F.explode(_each_copy(F.col("copies"))).alias("copy"))
    copies = copies.sortWithinPartitions("shard", *_in_shard(seed))
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(rf"[{X.SPACE}]*{X.WORD}"), F.lit(0))
    part = (F.col("copy") > F.col("epochs")) & (F.col("drawn") < F.col("size"))
    text = F.when(part, F.array_join(F.slice(words, 1, F.col("drawn").cast("int")), "")).otherwise(F.col("doc.text"))
    out = copies.select("doc", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
