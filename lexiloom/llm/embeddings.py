"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learnt on a bounded sample so that the signs of the rotated vectors are balanced
binary codes (ITQ). A code is cut into chunks, one for each table; each vector enters each table
under its chunk and under every chunk one bit away, so two vectors meet when some chunk differs in
at most two bits. (With 4 chunks of 16: all pairs with at most 11 differing bits, and most beyond.)
Pairs are then confirmed by the cosine of the original vectors in double precision. Chunks grow
with the logarithm of the number of vectors, so that a key holds as many of them whatever their number;
there are as many tables as it takes to find 99 of 100 pairs at the threshold.

A crowd of near copies shares its keys, but is not expanded into its pairs. Members of a crowd are
grouped by a leader that they link with (a cell). Members within half of the threshold's angle from
their leader link with one another, by the triangle inequality: they are counted. What is left of a cell, and
cells that meet others in a table, is compared block by block as matrix products, which give a
count and a component for each vector and no row for a pair. Equal vectors are one class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .store import dropped, saved

#: The narrowest chunk, and the missed share of pairs at the threshold that tables are added for.
CHUNK, MISSED = 16, 0.01
#: Differing bits of 100 that two codes may have at most.
APART = 34.4
#: Vectors under one chunk from which on they are grouped into cells, and rows of a block.
CROWD, BLOCK = 64, 512
#: Components of the vectors that a rotation is learnt on, in all.
LEARNT = 1 << 25


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a chunk, number of tables) for n vectors: chunks of log2 n bits, tables by the binomial chance of two bits at most."""
    chunk = min(31, max(CHUNK, math.ceil(math.log2(max(2, n)))))
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = sum(math.comb(chunk, k) * p**k * (1 - p) ** (chunk - k) for k in range(3))
    return chunk, 1 if met >= 1 else min(32, max(64 // chunk, math.ceil(math.log(MISSED) / math.log(1 - met))))


def learn_rotation(x: np.ndarray, n_bits: int, *, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to n_bits dimensions): principal directions, then the ITQ rotation.

    With fewer dimensions than bits, several rotations are learnt and put side by side.
    """
    mean = x.mean(axis=0)
    x = x - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:n_bits].T
    v, rng, parts, bits = x @ axes, np.random.default_rng(seed), [], 0
    while bits < n_bits:
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (left @ right).T
        parts.append(axes @ r)
        bits += r.shape[1]
    return mean, np.hstack(parts)[:, :n_bits]


def _sound(v: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length; shorter vectors are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), dims))
    x[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(vectors: DataFrame, dims: int, mean: np.ndarray, projection: np.ndarray, chunk: int) -> DataFrame:
    """(node, label, unit, size, c0, c1, ...) for ``vectors`` (node, label, embedding, size): vectors of unit length and the chunks of their codes."""
    names = [f"c{t}" for t in range(projection.shape[1] // chunk)]
    weights = 1 << np.arange(chunk, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("embedding"), dims)
            signs = ((x - mean) @ projection > 0).reshape(len(x), -1, chunk)
            cut = (signs * weights).sum(axis=2).astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), unit, batch.column("size"), *(pa.array(np.ascontiguousarray(c)) for c in cut.T)], names=["node", "label", "unit", "size", *names])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("node", "label", "embedding", "size").mapInArrow(run, f"node long, label {label}, unit array<double>, size long, " + ", ".join(f"{c} int" for c in names))


def _chunks(coded: DataFrame) -> list[str]:
    return [c for c in coded.columns if c[0] == "c" and c[1:].isdigit()]


def _entered(coded: DataFrame, *columns: str, masks: int = 0) -> DataFrame:
    """``columns`` of ``coded`` with (t, own, key): each table, the chunk there, and the keys it is entered under, the chunk's first ``masks`` bits turned."""
    at = F.posexplode(F.array(*_chunks(coded))).alias("t", "own")
    turned = F.array(F.lit(0), *(F.lit(1 << k) for k in range(masks)))
    rows = coded.select(*columns, at)
    return rows.withColumn("key", F.explode(F.transform(turned, lambda m: F.col("own").bitwiseXOR(m)))) if masks else rows.withColumn("key", F.col("own"))


def candidates(coded: DataFrame, chunk: int) -> DataFrame:
    """(a, b): pairs of ``coded`` (node, label, c0, ...) that meet in a table and differ in few enough bits, once each."""
    names = _chunks(coded)
    most = round(APART / 100 * chunk * len(names))
    keys = _entered(coded, "node", "label", *names, masks=chunk)
    x, y = keys.alias("x"), keys.alias("y")
    apart = [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in names]
    # A pair meets under several keys: it counts in the first table where it can meet, under one key there.
    first = F.lit(True)
    for t in range(len(names) - 1):
        first = first & ((F.col("x.t") <= t) | (apart[t] > 2))
    here = F.col("x.own").bitwiseXOR(F.col("y.own"))
    key = F.when(F.bit_count(here) == 2, F.col("x.own").bitwiseXOR(here.bitwiseAND(-here))).otherwise(F.col("x.own"))
    met = (F.col("x.node") < F.col("y.node")) & (sum(apart[1:], apart[0]) <= most) & (F.col("x.key") == key) & first
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key"))
    return x.join(y, same & met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _angle(x: Column | str, y: Column | str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(x, y))))


def _side(coded: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return coded.select(*(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def _cells(coded: DataFrame, threshold: float, rounds: int = 4) -> DataFrame | None:
    """(node, cell, angle): members of crowds by the leader that they link with, leaders included; None without crowds.

    A round takes, for each vector, the fullest chunk that it is under and that chunk's least vector as leader.
    """
    left, found = coded, None
    for _ in range(rounds):
        exact = _entered(left, "node", "label")
        full = saved(exact.groupBy("label", "t", "key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where(F.col("n") >= CROWD))
        if full.isEmpty():
            break
        picked = exact.join(full, ["label", "t", "key"]).groupBy("node").agg(F.max(F.struct("n", "t", "key", "leader")).alias("pick"))
        picked = saved(picked.select("node", F.col("pick.leader").alias("cell")))
        met = picked.join(_side(coded, "x", "node", "unit"), F.col("node") == F.col("x_node"))
        met = met.join(saved(_side(coded.join(picked.select(F.col("cell").alias("node")).distinct(), "node", "left_semi"), "y", "node", "unit")), F.col("cell") == F.col("y_node"))
        near = saved(met.where(_dot("x_unit", "y_unit") >= threshold).select("node", "cell", F.when(F.col("node") == F.col("cell"), 0.0).otherwise(_angle("x_unit", "y_unit")).alias("angle")))
        led = near.where("node = cell").select("cell").join(near.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell", "left_semi")
        new = saved(near.join(led, "cell", "left_semi").select("node", "cell", "angle"))
        dropped(full, picked, near)
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        left = saved(left.join(new.select("node"), "node", "left_anti"))
    return found


def _compared(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For two blocks (side, node, size, unit), or one with itself: (node, n, root) of the vectors that link, root being the least they are connected to here."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() else x
        unit = np.stack(rows["unit"].to_numpy()).astype(np.float64)
        linked = unit[x] @ unit[y].T >= threshold
        n, root = np.zeros(len(rows), np.int64), node.copy()
        if x is y:
            np.fill_diagonal(linked, False)
            n[x] = linked @ size[x]
        else:
            n[x], n[y] = linked @ size[y], linked.T @ size[x]
        while True:
            before, none = root.copy(), np.iinfo(np.int64).max
            root[x] = np.minimum(root[x], np.where(linked, root[y][None, :], none).min(axis=1, initial=none))
            root[y] = np.minimum(root[y], np.where(linked, root[x][:, None], none).min(axis=0, initial=none))
            if (before == root).all():
                break
        some = n > 0
        return pd.DataFrame({"node": node[some], "n": n[some], "root": root[some]})

    return run


def _crowded(coded: DataFrame, cells: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(node, n, root): links within cells, and of cells with each other and with single vectors that they meet in a table."""
    wide = math.acos(min(1.0, max(-1.0, threshold)))
    core = F.col("angle") <= wide / 2 - 1e-9
    members = saved(coded.join(cells, "node").select("node", "label", "size", "unit", "cell", "angle", core.alias("core"), *_chunks(coded)))
    of_cell = members.groupBy("cell", "core").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.max("angle").alias("r"))
    of_cell = saved(of_cell)
    sure = members.where("core").join(of_cell.where("core").select("cell", "all"), "cell").select("node", (F.col("all") - F.col("size")).alias("n"), F.col("cell").alias("root")).where("n > 0")
    # Blocks: core and other members apart, each dealt by hash to parts of some BLOCK rows.
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = members.join(of_cell.select("cell", "core", parts.alias("parts")), ["cell", "core"])
    blocked = saved(blocked.select("cell", (2 * F.pmod(F.xxhash64("node"), F.col("parts")).cast("int") + F.col("core").cast("int")).alias("part"), "node", "size", "unit"))
    blocks = saved(blocked.select("cell", "part").distinct().withColumn("core", F.col("part") % 2 == 1))
    x, y = blocks.alias("x"), blocks.alias("y")
    within = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.part") <= F.col("y.part")) & ~(F.col("x.core") & F.col("y.core")))
    within = within.select(F.col("x.cell").alias("x_cell"), F.col("x.part").alias("x_part"), F.col("y.cell").alias("y_cell"), F.col("y.part").alias("y_part"))
    # Cells and single vectors that meet in a table, those aside whose leaders are too far apart.
    held = _entered(members, "label", "cell", masks=chunk).select("label", "t", "key", "cell").distinct()
    own = saved(held)
    single = coded.join(cells.select("node"), "node", "left_anti")
    own = own.withColumn("many", F.lit(True)).unionByName(
        _entered(single, "label", "node", masks=chunk).join(own.select("label", "t", "key").distinct(), ["label", "t", "key"], "left_semi").select("label", "t", "key", F.col("node").alias("cell"), F.lit(False).alias("many"))
    )
    x, y = own.alias("x"), own.where("many").alias("y")
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key"))
    met = x.join(y, same & (~F.col("x.many") | (F.col("x.cell") < F.col("y.cell")))).select(F.col("x.cell").alias("x_cell"), F.col("y.cell").alias("y_cell")).distinct()
    reach = of_cell.groupBy("cell").agg(F.max("r").alias("r"))
    for p in "xy":
        met = met.join(_side(coded, p, "node", "unit"), F.col(f"{p}_cell") == F.col(f"{p}_node")).join(reach.select(F.col("cell").alias(f"{p}_cell"), F.col("r").alias(f"{p}_r")), f"{p}_cell", "left")
    near = _angle("x_unit", "y_unit") <= wide + F.coalesce("x_r", F.lit(0.0)) + F.coalesce("y_r", F.lit(0.0)) + 1e-9
    across = saved(met.where(near).select("x_cell", "y_cell"))
    for p in "xy":
        across = across.join(_side(blocks, p, "cell", "part"), f"{p}_cell", "left").withColumn(f"{p}_part", F.coalesce(f"{p}_part", F.lit(0)))
    pairs = saved(within.unionByName(across.select("x_cell", "x_part", "y_cell", "y_part")).withColumn("pair", F.monotonically_increasing_id()))
    lone = single.join(pairs.select(F.col("x_cell").alias("node")).distinct(), "node", "left_semi")
    blocked = blocked.unionByName(lone.select(F.col("node").alias("cell"), F.lit(0).alias("part"), "node", "size", "unit"))
    of_side = lambda p, k, rows: rows.select(F.col(f"{p}_cell").alias("cell"), F.col(f"{p}_part").alias("part"), "pair", F.lit(k).alias("side"))
    sides = of_side("x", 0, pairs).unionByName(of_side("y", 1, pairs.where("x_cell <> y_cell OR x_part <> y_part")))
    tasks = sides.join(blocked, ["cell", "part"]).select("pair", "side", "node", "size", "unit")
    return sure.unionByName(tasks.groupBy("pair").applyInPandas(_compared(threshold), "node long, n long, root long"))


def near_vectors(table: DataFrame, *, threshold: float = 0.93, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """One row for each row of ``table`` (vec_id, embedding, label): row, vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null and their cosine is at least
    ``threshold``. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, and vectors of different lengths don't link; tiny and huge components are scaled first.
    The rotation is learnt on ``sample`` vectors at most, fewer if they are very long; all vectors are coded. Repeated rows link
    with each other and count each. component_id is the least vec_id reachable, null ids aside; kept
    marks the rows with that id. An empty table gives no row. Other columns are not read.
    """
    rows = saved(table.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")))
    sound = rows.where(F.col("label").isNotNull() & _sound(F.col("embedding")))
    least_dims, dims = sound.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    alone = rows.select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if dims is None:
        return alone
    if least_dims < dims:  # what has another length is as what has another label
        sound = saved(sound.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))))
    classes = saved(sound.groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count("*").alias("size"), F.min("vec_id").alias("least_id")))
    chunk, n_tables = tables_for(classes.count(), threshold)
    picked = classes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(min(sample, max(64, LEARNT // dims))).select("embedding").toArrow()
    mean, projection = learn_rotation(_units(picked.column(0).combine_chunks(), dims), chunk * n_tables, seed=seed)
    coded = saved(codes(classes, dims, mean, projection, chunk))
    cells = _cells(coded, threshold)
    single = coded if cells is None else coded.join(cells.select("node"), "node", "left_anti")
    pairs = saved(candidates(single.drop("unit", "size"), chunk))
    met = pairs.join(_side(coded, "x", "node", "size", "unit"), F.col("a") == F.col("x_node")).join(_side(coded, "y", "node", "size", "unit"), F.col("b") == F.col("y_node"))
    links = saved(met.where(_dot("x_unit", "y_unit") >= threshold).select("a", "b", "x_size", "y_size"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("y_size").alias("n")), F.struct(F.col("b").alias("node"), F.col("x_size").alias("n"))))
    counts, edges = links.select(ends.alias("e")).select("e.node", "e.n"), links.select("a", "b")
    if cells is not None:
        crowded = saved(_crowded(coded, cells, threshold, chunk))
        counts, edges = counts.unionByName(crowded.select("node", "n")), edges.unionByName(crowded.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    roots = saved(components(edges))
    of_class = saved(classes.join(roots, "node", "left").select("label", "embedding", "node", "size", "least_id", F.coalesce("root", "node").alias("root")))
    least = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = saved(of_class.join(counts, "node", "left").join(saved(least), "root").select("label", "embedding", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    found = sound.join(of_class, ["label", "embedding"]).select("row", F.col("n_links").alias("n"), F.col("component_id").alias("c"))
    out = rows.select("row", "vec_id").join(saved(found), "row", "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("row", "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
