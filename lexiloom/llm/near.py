"""Near-duplicate documents: b-bit minwise signatures and a multi-index Hamming join.

A document is the set of its word shingles. Its signature has SYMBOLS minima of b = 16 bits, cut
into chunks of WIDTH. By the pigeonhole principle two signatures that differ in fewer than twice as
many symbols as there are chunks have a chunk with at most one difference; each chunk is entered
once for every position left out, so all such pairs share a key. (With 8 chunks of 5: all pairs
under 16 differing symbols of 40, where 8 are expected at the similarity of 0.8. Pairs beyond often
meet as well: in all, fewer than 3 in 100,000 links at just 0.8 are missed, and fewer above.)

Links are confirmed on the full sets. A group of copies is never expanded into its pairs:

1. documents with equal sets are one class;
2. each class is compared with the least class that it shares a key with;
3. then, under keys that still hold several components, with the most central class
   of another component, the one with the least share of shingles that none but its component has;
4. then with every class of another component under a common key.

In steps 3 and 4 classes are left out that can link with none there, and pairs that cannot link, by bounds
that hold for all sets: a class shares no more than what of it occurs in other components; and two classes
no more than the bits that their bitmaps have in common and the shingles of the smaller rest, those
beyond one for each bit. (Edits are a copy's own, so copies too far from the rest of their group are such.)

Classes that are connected need no comparison, so each step leaves little to the next, and after the
last all pairs that share a key were compared, are connected or are proven not to be similar enough.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .store import dropped, saved

CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Longs of a class's bitmap, for classes under contested keys alone: a bit for each remainder of a shingle's hash.
MAP = 32

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_C = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_D = _rng.integers(0, 2**63, (CHUNKS, WIDTH), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Keeps the hashes of recent words."""

    def __init__(self, words: int, max_words: int = 100_000) -> None:
        self._n, self._max = words, max_words
        self._known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """A-Z lower-cased; words between white space; with fewer words than a shingle, all of them as one."""
        import xxhash

        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self._known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self._max:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = min(self._n, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = (s + h[k : len(h) - n + 1 + k]) * _STEP
        s = np.sort(_mixed(s))
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out, step = None, (1 << 17) // SYMBOLS
    for at in range(0, len(x), step):
        low = (np.multiply.outer(_A, x[at : at + step]) + _B[:, None]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def signature_keys(low: np.ndarray) -> np.ndarray:
    """For rows of minima: a key for each chunk and each position of it left out."""
    symbols = (_mixed(low.astype(np.uint64)) >> np.uint64(48)).reshape(-1, CHUNKS, WIDTH)
    parts = (symbols + np.uint64(1)) * _C
    keys = _mixed(parts.sum(axis=2, dtype=np.uint64)[:, :, None] - parts + _D)
    return keys.reshape(len(low), -1).view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """MAP longs with the bits of all remainders that occur."""
    bits = np.zeros(MAP * 64, np.uint8)
    bits[(shingles % np.uint64(MAP * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


_FEATURES = "row long, doc_id long, content long, n long, hi long, lo long, keys array<long>"


def _features(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([(c, pa.list_(pa.int64()) if c == "keys" else pa.int64()) for c in (x.split()[0] for x in _FEATURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        shingler, row = Shingler(words), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                n = np.zeros(len(batch), np.int64)
                low = np.zeros((len(batch), SYMBOLS), np.uint32)
                ids = np.zeros((len(batch), 2), np.int64)
                for k, text in enumerate(batch.column("text")):
                    s = shingler.of(text.as_py())
                    n[k] = len(s)
                    if len(s):
                        low[k] = minima(s)
                        ids[k] = np.frombuffer(xxhash.xxh3_128_digest(s), np.int64)
                keys, rows = signature_keys(low), np.arange(row, row + len(batch))
                row += len(batch)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, keys.shape[1], 0)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel()))
                columns = [pa.array(rows), batch.column("doc_id"), batch.column("content"), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in ids.T), keys]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(run, _FEATURES)


def _confirmed(pairs: DataFrame, bodies: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= similarity * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(words), OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if node in recent:
                recent.move_to_end(node)
            else:
                recent[node] = shingler.of(text)
                if len(recent) > 500:
                    recent.popitem(last=False)
            return recent[node]

        for batch in batches:
            keep = np.zeros(len(batch), bool)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for k, (p, q) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                s, t = of(a[k], p.as_py()), of(b[k], q.as_py())
                if 100 * min(len(s), len(t)) >= similarity * max(len(s), len(t)):
                    both = len(s) + len(t)
                    union = np.sort(np.concatenate((s, t)), kind="stable")
                    shared = int((union[1:] == union[:-1]).sum())
                    keep[k] = 100 * shared >= similarity * (both - shared)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    met = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    met = met.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with(keyed: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """``keyed`` with the component that each ``node`` is in so far: its own, if it has no link."""
    out = keyed.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left")
    return out.withColumn(name, F.coalesce("_root", node)).drop("_root")


def _shares(own: DataFrame, bodies: DataFrame, words: int, similarity: int, rounds: int = 2) -> DataFrame:
    """(node, shared, rest, w0, w1, ...) for the classes of ``own`` (key, node, root) that can link with one of another component.

    ``shared`` counts a class's shingles that occur in another component here; a link needs at least
    ``similarity`` percent of them. Once classes are out, fewer shingles occur in several components,
    hence the second round. w0 and on are the bitmap, ``rest`` counts the shingles beyond one for each of its bits.
    """
    maps = [f"w{k}" for k in range(MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.of(text.as_py()) for text in batch.column("text")]
            bits = np.array([bitmap(s) for s in sets], np.int64).reshape(len(sets), MAP)
            rest = np.array([len(s) for s in sets], np.int64) - np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
            columns = [batch.column("node"), batch.column("root"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(rest), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "shingles", "rest", *maps])

    schema = "node long, root long, shingles array<long>, rest long, " + ", ".join(f"{w} long" for w in maps)
    sets = saved(own.select("node", "root").distinct().join(bodies, "node").select("node", "root", "text").mapInArrow(run, schema))
    slim = sets.select("node", "rest", *maps)
    for _ in range(rounds):
        each = sets.select("node", "root", F.explode("shingles").alias("shingle"))
        common = saved(each.groupBy("shingle").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("shingle"))
        there = saved(each.join(common, "shingle").groupBy("node").agg(F.count("*").alias("shared")))
        sets = saved(sets.drop("shared").join(there, "node").where(100 * F.col("shared") >= similarity * F.size("shingles")).select("node", "root", "shingles", "shared"))
    return sets.select("node", "shared").join(slim, "node")


def _contested(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root): the rows of ``keyed`` (key, node) whose key holds several components."""
    own = saved(_with(keyed.select("key", "node"), roots, "node", "root"))
    mixed = saved(own.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key"))
    return own.join(mixed, "key")


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: int = 80) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id, content, n_shingles, component_id, kept.

    Texts link when they share ``similarity`` percent of the union of their shingles of ``words``
    words. Texts that are null, empty or white space have no shingle and link with nothing.
    component_id is the least doc_id reachable, null ids aside. ``kept`` marks one row of each
    component: of those with the least doc_id the first. Repeated rows have equal sets. An empty
    table gives no row. Columns but these two are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = saved(_features(docs, words))
    classes = rows.where("n > 0").select("hi", "lo", "row", "doc_id").groupBy("hi", "lo")
    classes = saved(classes.agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")))
    nodes = saved(rows.drop("hi", "lo").join(classes.select("row", "least"), "row").withColumnRenamed("row", "node"))

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = saved(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least"))
    keyed = saved(keyed.join(shared, "key").select("key", "node", F.col("least").alias("first")))
    bodies = saved(_bodies(docs, nodes.join(keyed.select("node").distinct(), "node", "left_semi")))

    stars = keyed.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = saved(stars.groupBy("a").agg(F.min("b").alias("b")))
    links = saved(_confirmed(near, bodies, words, similarity))
    roots = saved(components(links))

    slim = nodes.select("node", "n")
    facts = ["n", "shared", "rest", *(f"w{k}" for k in range(MAP))]
    own = saved(_contested(keyed, roots))
    known = saved(_shares(own, bodies, words, similarity).join(slim, "node"))
    own = saved(own.join(known, "node"))
    centre = F.struct((1 - F.col("shared") / F.col("n")).alias("apart"), "node", "root", *facts)
    centres = saved(own.groupBy("key").agg(F.min(centre).alias("y")))
    met = own.withColumnRenamed("key", "k").withColumn("x", F.struct("node", "root", *facts)).select("k", "x").join(centres, F.col("k") == F.col("key"))
    met = met.where((F.col("x.root") != F.col("y.root")) & _plausible("x", "y", similarity))
    near = saved(met.groupBy(F.col("x.node").alias("a")).agg(F.min(F.struct("y.apart", "y.node")).alias("y")).select("a", F.col("y.node").alias("b")))
    links = saved(links.unionByName(_confirmed(near, bodies, words, similarity)))
    roots = saved(components(links))

    # What a class shares with other components only falls as components grow: the counts still bound it.
    own = saved(_contested(keyed.join(known.select("node"), "node", "left_semi"), roots).join(known, "node").join(nodes.select("node", "keys"), "node"))
    x, y = own.alias("x"), own.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    rest = saved(x.join(y, met & _plausible("x", "y", similarity) & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    links = saved(links.unionByName(_confirmed(rest, bodies, words, similarity)))
    roots = saved(components(links))

    of_class = saved(_with(classes.select(F.col("row").alias("node"), "hi", "lo", "least"), roots, "node", "root"))
    heads = saved(of_class.groupBy("root").agg(F.min("least").alias("head")))
    of_class = saved(of_class.join(heads, "root").select("hi", "lo", "head"))
    out = rows.select("row", "doc_id", "content", "n", "hi", "lo").join(of_class.hint("merge"), ["hi", "lo"], "left")
    alone = F.col("head").isNull()
    return out.select(
        "row", "doc_id", "content", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"),
    )


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for these classes: the text of the class's first row."""
    wanted = nodes.select("node", F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
    texts = docs.withColumn("content", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["content"] == wanted["_content"])
    return wanted.join(texts, same).groupBy("node").agg(F.first("text").alias("text"))


def _plausible(x: str, y: str, similarity: int) -> Column:
    """Whether the sizes, shared shingles and bitmaps of two classes allow the similarity: false only if it is out of reach."""
    least, most = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    both = lambda k: F.bit_count(F.col(f"{x}.w{k}").bitwiseAND(F.col(f"{y}.w{k}")))
    enough = lambda common: 100 * common >= similarity * (least + most - common)
    return enough(least) & enough(F.least(f"{x}.shared", f"{y}.shared")) & enough(sum((both(k) for k in range(1, MAP)), both(0)) + F.least(f"{x}.rest", f"{y}.rest"))
