"""The trie of conversations' beginnings, summed over by heavy paths.

Every distinct beginning of conversations is a node. A turn travels as a digest; a beginning's name is a
digest of its turns' digests, worked out in runs: within a run of turns, then over the runs. Nodes
are sums over equal names with partial results in the map tasks.

Below a node, the child with most members is heavy, all others are light. A light child has
half of its parent's members at most, so that no node lies under more than log2 n light edges. Heavy
edges make paths. A path's head is found by doubling pointers; subtree sums are suffix sums along the path,
again in runs, after each light path below has given its total to the parent of its head: paths whose
heads have 1, 2-3, 4-7, ... members are done in turn, and none waits for one that comes later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import dropped, saved

#: Turns or nodes of a run; ids in a block of a digest, as a power of two.
RUN, IDS = 64, 12


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, print, chars): turns (conv_id, turn, role, text) numbered from 1 in each conversation.

    Order is by turn, null first, then by role and by the digest of role and text. A long conversation is
    spread over sorted partitions. Turns without a conv_id belong to none and are left out; null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("print"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    placed = saved(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("turn", "role"))
    part = F.shiftright("at", 33)
    begun = placed.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition that has turns of it
    begun = saved(begun.select("conv_id", F.col("part").alias("_part"), "first", earlier.alias("earlier")))
    rows = placed.withColumn("_part", part).join(begun, ["conv_id", "_part"])
    return saved(rows.select("conv_id", (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("nth"), "print", "chars"))


def branched(turns: DataFrame, *, block: int = 100, most: int = 6) -> DataFrame:
    """``turns`` as of :func:`numbered`, rebuilt so that conversations share beginnings: conversation c has the first h turns of
    conversation c - c % ``block``, then its own after its first h, with h = crc32(decimal c) % ``most``. A row of nulls but for conv_id stands for one without turns.
    """
    id_ = F.col("conv_id")
    h = F.crc32(id_.cast("string").cast("binary")) % most
    convs = saved(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": id_ - id_ % block}))
    sizes = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most - 1)).alias("base_n"))
    convs = saved(convs.join(sizes, "base", "left").select("conv_id", "h", "base", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    first = saved(turns.where(F.col("nth") < most).withColumnRenamed("conv_id", "base"))
    shared = convs.join(first, "base").where("nth <= h").select("conv_id", "nth", "print", "chars")
    own = turns.join(convs, "conv_id").where("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("nth"), "print", "chars")
    bare = convs.where("taken = 0 AND n <= h").select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("nth", "long"), ("print", "string"), ("chars", "long"))))
    return shared.unionByName(own).unionByName(bare)


def _names(turns: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, name) of ``turns`` (conv_id, depth, print): two names are equal if both beginnings are."""
    run = F.floor((F.col("depth") - 1) / RUN)
    begin = F.struct(F.lit("").alias("last"), F.expr("cast(array() AS array<string>)").alias("all"))
    named = lambda s, x: F.sha2(F.concat(s["last"], x["print"]), 256)
    step = lambda s, x: F.struct(named(s, x).alias("last"), F.concat(s["all"], F.array(named(s, x))).alias("all"))
    runs = turns.groupBy("conv_id", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("depth", "print"))).alias("own"))
    runs = runs.select("conv_id", "run", F.transform("own", lambda x: x["depth"]).alias("depths"), F.aggregate("own", begin, step, lambda s: s["all"]).alias("names"))
    rows = F.explode(F.arrays_zip("depths", "names")).alias("x")
    if deepest <= RUN:
        return runs.select("conv_id", rows).select("conv_id", F.col("x.depths").alias("depth"), F.col("x.names").alias("name"))
    runs = saved(runs)
    over = _names(runs.select("conv_id", (F.col("run") + 1).alias("depth"), F.element_at("names", -1).alias("print")), -(-deepest // RUN))
    before = saved(over.select("conv_id", F.col("depth").alias("run"), F.col("name").alias("before")))
    rows = runs.join(before, ["conv_id", "run"], "left").select("conv_id", "before", rows)
    name = F.when(F.col("before").isNull(), F.col("x.names")).otherwise(F.sha2(F.concat("before", "x.names"), 256))
    return rows.select("conv_id", F.col("x.depths").alias("depth"), name.alias("name"))


def _suffix_sums(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` (path, at, key, leaves, saved) with the sums of leaves and saved over places from ``at`` on; a path has at most ``longest`` places, numbered from 0."""
    runs = rows.groupBy("path", F.floor(F.col("at") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "key", "leaves", "saved")), False).alias("own"))
    item = "struct<at:bigint,key:struct<conv_id:bigint,depth:bigint>,leaves:bigint,saved:bigint>"
    begin = F.struct(F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.expr(f"cast(array() AS array<{item}>)").alias("all"))

    def step(s: Column, x: Column) -> Column:
        leaves, kept = s["leaves"] + x["leaves"], s["saved"] + x["saved"]
        return F.struct(leaves.alias("leaves"), kept.alias("saved"), F.concat(s["all"], F.array(F.struct(x["at"].alias("at"), x["key"].alias("key"), leaves.alias("leaves"), kept.alias("saved")))).alias("all"))

    runs = runs.select("path", "run", F.aggregate("own", begin, step).alias("sums"))
    if longest <= RUN:
        return runs.select("path", F.explode("sums.all").alias("x")).select("path", "x.*")
    runs = saved(runs)
    over = _suffix_sums(runs.select("path", F.col("run").alias("at"), F.lit(None).cast("struct<conv_id:bigint,depth:bigint>").alias("key"), "sums.leaves", "sums.saved"), -(-longest // RUN))
    after = saved(over.select("path", (F.col("at") - 1).alias("run"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")))
    rows = runs.join(after, ["path", "run"], "left").select("path", F.explode("sums.all").alias("x"), F.coalesce("more_leaves", F.lit(0)).alias("l"), F.coalesce("more_saved", F.lit(0)).alias("s"))
    return rows.select("path", "x.at", "x.key", (F.col("x.leaves") + F.col("l")).alias("leaves"), (F.col("x.saved") + F.col("s")).alias("saved"))


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ``ends`` (key, conv_id), key a string: the digest of all ids of a key, ascending, comma-joined.

    Ids are joined in blocks; the blocks of a key pass through one task in order, and only one is held at a time.
    """
    blocks = ends.groupBy("key", F.shiftright("conv_id", IDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = saved(blocks)
    many = blocks.groupBy("key").agg(F.count("*").alias("n"), F.any_value("ids").alias("ids"))
    lone = many.where("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    rest = blocks.join(many.where("n > 1").select("key"), "key", "left_semi")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if h is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return lone.unionByName(rest.select("key", "block", "ids").repartition("key").sortWithinPartitions("key", "block").mapInArrow(digest, "key string, ends_sha256 string"))


def _nodes(turns: DataFrame) -> DataFrame:
    """Of each distinct beginning: name ('': the root), depth, conv_id (smallest member), n_convs, chars of its last text, parent (a name) and parent_conv_id."""
    some = saved(turns.where("nth IS NOT NULL").withColumnRenamed("nth", "depth"))
    deepest = some.agg(F.max("depth")).first()[0] or 0
    names = saved(_names(some, deepest))
    rows = names.join(some, ["conv_id", "depth"])
    nodes = rows.groupBy("name").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    root = turns.agg(F.lit("").alias("name"), F.lit(0).cast("long").alias("depth"), F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n_convs"), F.lit(0).cast("long").alias("chars")).where("n_convs > 0")
    nodes = saved(nodes.unionByName(root))
    above = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = nodes.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, F.lit("")).otherwise(F.col("parent")))
    least = saved(nodes.select("name", "conv_id", "depth", "n_convs", "chars", "parent"))
    ids = least.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = saved(least.join(ids, "parent", "left"))
    last = names.groupBy("conv_id").agg(F.max_by("name", "depth").alias("key"))
    ends = turns.select("conv_id").distinct().join(last, "conv_id", "left").select(F.coalesce("key", F.lit("")).alias("key"), "conv_id")
    return saved(out.join(saved(_digests(ends)), out["name"] == F.col("key"), "left").drop("key", "name", "parent"))


_KEY = ["conv_id", "depth"]


def _headed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path (the key of the head of its heavy path), by pointers that double their reach in each round."""
    parent = F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    key = F.struct(*_KEY).alias("key")
    heavy = nodes.where("depth > 0").groupBy(parent.alias("parent")).agg(F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("most"))
    heavy = saved(heavy.select(F.struct((-F.col("most.least")).alias("conv_id"), (F.col("parent.depth") + 1).alias("depth")).alias("key"), F.col("parent").alias("to"), F.lit(False).alias("done")))
    left = heavy.count()
    while left:
        # A pointer to a node without a pointer has come to a head. Pointers of one path that aren't done have different targets.
        ahead = heavy.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("done").alias("at_head"))
        moved = heavy.where("NOT done").join(ahead, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.coalesce("at_head", F.lit(True)).alias("done"))
        new = saved(heavy.where("done").unionByName(moved))
        dropped(heavy)
        heavy, left = new, new.where("NOT done").count()
    return nodes.withColumn("key", key).join(heavy.select("key", F.col("to").alias("path")), "key", "left").withColumn("path", F.coalesce("path", "key"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, nth, print, chars), as of :func:`numbered` or :func:`branched`.

    conv_id (smallest member) and depth name a node; parent_conv_id is null for the root, which all conversations are members of, those
    without turns (nth null) too. n_convs, n_children; over the subtree with its top n_leaves and saved_tokens, each
    node's (n_convs - 1) times the code points of its last text; ends_sha256 of the members that end here. Without conversations there is no node.
    """
    nodes = _nodes(turns)
    children = saved(nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children")))
    nodes = saved(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    headed = saved(_headed(nodes.select(*_KEY, "parent_conv_id", "n_convs", "n_children", "chars")))
    is_head = F.col("key") == F.col("path")
    rank = F.length(F.bin("n_convs")) - 1  # floor of log2
    heads = saved(headed.where(is_head).select("path", rank.alias("rank"), F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))).alias("over")))
    own = headed.select("key", "path", (F.col("depth") - F.col("path.depth")).alias("at"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = saved(own.join(heads, "path"))
    ranks = own.groupBy("rank").agg(F.max("at").alias("at")).orderBy("rank").collect()  # a row for each power of two
    over = saved(heads.where("over IS NOT NULL").select("path", "over").join(own.select(F.col("key").alias("over"), F.col("rank").alias("for_rank")), "over").select("path", "over", "for_rank"))
    given, sums = None, None
    for r in ranks:
        now = own.where(F.col("rank") == r["rank"]).select("path", "at", "key", "leaves", "saved")
        if given is not None:
            more = given.where(F.col("for_rank") == r["rank"]).groupBy(F.col("over").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            now = now.join(more, "key", "left").select("path", "at", "key", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        done = saved(_suffix_sums(now, r["at"] + 1))
        up = saved(done.where(is_head).join(over, "path").select("over", "for_rank", "leaves", "saved"))
        given = up if given is None else given.unionByName(up)
        sums = done if sums is None else sums.unionByName(done)
    if sums is None:
        sums = own.select("path", "at", "key", "leaves", "saved")
    sums = saved(sums.select("key.conv_id", "key.depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    empty = F.sha2(F.lit(""), 256)
    return nodes.join(sums.hint("merge"), _KEY).select(*_KEY, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
