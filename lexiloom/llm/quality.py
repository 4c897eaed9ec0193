"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: of the target (labelled good documents) and of
the raw text (all documents). A passage's weight is the likelihood ratio of the two; a document is
worth what its weakest passages are, of two or four words (an insult) and of a few lines (noise), so
a long clean text cannot outweigh them. Documents are then resampled without replacement by these
weights: the k largest of log weight / temperature + Gumbel noise stay, where k is the number of
documents that weigh as much as target documents do.

Counts shrink to the raw shares: an n-gram seen r times in all is trusted as r / (r + prior).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import saved, small_batches

#: For each order of n-grams: bits of a bucket's number. The models are as large whatever the input.
BITS = {1: 20, 2: 16}
#: For each order: the prior.
PRIORS = {1: 4.0, 2: 60.0}
#: Passages by which a document is judged: order of n-grams, and how many of them.
WINDOWS = ((1, 2), (1, 4), (1, 32), (2, 32))
Windows = tuple[tuple[int, int], ...]
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hasher:
    """Hashes of a text's words, and the buckets of their n-grams. Keeps the hashes of recent words."""

    def __init__(self, orders: tuple[int, ...], max_words: int = 150_000) -> None:
        self._orders, self._max = orders, max_words
        self._known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        words, known = _TOKEN.findall((text or "").lower()), self._known
        if len(known) > self._max:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF
        return np.array([known[w] for w in words], np.uint32)

    def grams(self, words: np.ndarray) -> dict[int, np.ndarray]:
        h, out = words.astype(np.uint64), {}
        for n in self._orders:
            g = np.full(max(0, len(h) - n + 1), n, np.uint64)
            for k in range(n):
                g = (g ^ h[k : len(h) - n + 1 + k]) * _STEP
            out[n] = (g >> np.uint64(64 - BITS[n])).astype(np.int64)
        return out

    def __call__(self, text: str | None) -> dict[int, np.ndarray]:
        return self.grams(self.words(text))


def _part(doc_id: int) -> float:
    """A number in [0, 1) by which labelled documents are set aside to fit the floors."""
    import xxhash

    return xxhash.xxh3_64_intdigest(str(doc_id)) / 2**64


def _counts(docs: DataFrame, labelled: dict[int, bool], orders: tuple[int, ...]) -> DataFrame:
    """(n, bucket, raw, target): summed over all texts and over good ones, copies of a text counted once.

    What is shuffled of a text, to meet its copies, are the hashes of its words: fewer bytes than the text has.
    """
    judged = docs.sparkSession.createDataFrame(list(labelled.items()), "_id long, good boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(judged), F.col("doc_id") == F.col("_id"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = _Hasher(orders)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(0)]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
            columns = [*(pa.array(np.ascontiguousarray(c)) for c in marks.T), batch.column(1), pa.array([hasher.words(t).astype("<u4").tobytes() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "good", "words"])

    marked = rows.select("text", "good").mapInArrow(read, "hi long, lo long, good boolean, words binary")
    texts = marked.groupBy("hi", "lo").agg(F.coalesce(F.min("good"), F.lit(False)).alias("good"), F.first("words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(orders)
        counts = {n: np.zeros((2, 1 << BITS[n]), np.int64) for n in orders}
        for batch in batches:
            for words, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for n, g in hasher.grams(np.frombuffer(words.as_py(), "<u4")).items():
                    for own in counts[n][: 1 + good]:
                        np.add.at(own, g, 1)
        for n in orders:
            seen = np.flatnonzero(counts[n][0])
            for at in range(0, len(seen), 1 << 14):
                some = seen[at : at + (1 << 14)]
                columns = [np.full(len(some), n, np.int32), some.astype(np.int32), *counts[n][:, some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n", "bucket", "raw", "target"])

    counted = texts.select("words", "good").mapInArrow(run, "n int, bucket int, raw long, target long")
    return counted.groupBy("n", "bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "target")))


def fit(docs: DataFrame, labelled: dict[int, bool], priors: dict[int, float]) -> dict[int, np.ndarray]:
    """The log ratio for each bucket and order: target over raw. Fixed in size, whatever the input.

    Raw counts are over all texts, labelled or not; a group of copies is one text, so its size alone
    doesn't make it noise.
    """
    with small_batches(docs.sparkSession):
        rows = _counts(docs, labelled, tuple(priors)).toArrow()
    columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
    out = {}
    for n, prior in priors.items():
        raw, target = (columns[c][columns["n"] == n].astype(np.float64) for c in ("raw", "target"))
        share = target.sum() / max(1, raw.sum())
        ratio = np.zeros(1 << BITS[n], np.float32)
        if share:
            ratio[columns["bucket"][columns["n"] == n]] = np.log((target + prior * share) / (share * (raw + prior)))
        out[n] = ratio
    return out


def weakest(ratios: dict[int, np.ndarray], grams: dict[int, np.ndarray], windows: Windows) -> list[float]:
    """For each kind of passage, the least log ratio of one (of the whole text, if shorter)."""
    sums = {n: np.concatenate(([0.0], np.cumsum(ratios[n][g], dtype=np.float64))) for n, g in grams.items()}
    return [float((sums[n][w:] - sums[n][:-w]).min()) if len(sums[n]) > w + 1 else float(sums[n][-1]) for n, w in windows]


def _weigh(docs: DataFrame, ratios: dict[int, np.ndarray], windows: Windows) -> Callable[[Column], Column]:
    """Text to array<double>: the weakest passage of each kind."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("array<double>")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _Hasher(tuple(model.value))
        for texts in parts:
            yield pa.array([weakest(model.value, hasher(t.as_py()), windows) for t in texts], pa.list_(pa.float64()))

    return weigh


def _gumbel(seed: int, doc_id: str, text: str) -> Column:
    """Noise that depends on the row alone, so a task that runs anew draws the same."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(2**52)) + 0.5) / F.lit(2.0**52)
    return -F.log(-F.log(unit))


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 10_000, bins: int = 4096) -> float:
    """The k-th largest value, exactly, by histograms of ever narrower ranges."""
    x = F.col(column)
    lo, hi = rows.agg(F.min(x), F.max(x)).first()
    while True:
        width = (hi - lo) / bins
        inside = rows.where((x >= lo) & (x <= hi))
        if not width or lo + width == lo:
            return lo
        slot = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
        for row in sorted(inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: -r.slot):
            if row.n >= k:
                break
            k -= row.n
        lo, hi = row.lo, row.hi
        if row.n <= few:
            return sorted((r[0] for r in rows.where((x >= lo) & (x <= hi)).select(x).collect()), reverse=True)[k - 1]


@dataclass(frozen=True)
class Scored:
    """A fitted classifier and what it found: ``rows`` has doc_id, log_weight and key for each document."""

    rows: DataFrame
    ratios: dict[int, np.ndarray]
    windows: Windows
    floors: tuple[float, ...]
    temperature: float
    seed: int
    #: The key from which on a document stays. None: all stay.
    cut: float | None

    def kept(self) -> Column:
        return F.lit(True) if self.cut is None else F.col("key") >= self.cut

    def filtered(self, docs: DataFrame) -> DataFrame:
        """The documents that stay, all columns as they are. Scores them anew, so no text is shuffled or stored."""
        if self.cut is None:
            return docs
        whole = docs.select(F.struct(*docs.columns).alias("doc"))
        key = _log_weight(_weigh(docs, self.ratios, self.windows)(F.col("doc.text")), self.floors) / self.temperature + _gumbel(self.seed, "doc.doc_id", "doc.text")
        return whole.where(key >= self.cut).select("doc.*")


def score(
    docs: DataFrame, labels: DataFrame, *, label_rows: int = 60_000, held_out: float = 0.2, floor_share: float = 0.005,
    temperature: float = 0.05, priors: dict[int, float] | None = None, windows: Windows = WINDOWS, seed: int = 10,
) -> Scored:
    """Fit the two models, weigh every row of ``docs`` (doc_id, text) and find which stay.

    The target are ``labels`` (doc_id, quality, toxic) of quality 1 that aren't toxic; ``label_rows``
    labels are read at most, chosen by hash. Of the target a share ``held_out`` isn't counted but
    sets, for each kind of passage, the floor below which ``floor_share`` of target documents lie.
    The log weight is the least excess over the floors: 0 and more is like the target.

    Null and empty texts have passages of weight 0. Repeated rows have equal keys: all stay or none.
    A document that is labelled twice is good if all its labels are. Null labels and labels of no
    document are passed over; without a target, and for an empty table, all stay. Other columns are
    not read.
    """
    priors = priors or PRIORS
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"))
    picked = {r.doc_id: r.good for r in judged.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(label_rows).collect()}
    aside = [i for i, fine in picked.items() if fine and _part(i) < held_out]
    ratios = fit(docs, {i: fine for i, fine in picked.items() if _part(i) >= held_out}, priors)
    slim = docs.select("doc_id", _weigh(docs, ratios, windows)(F.col("text")).alias("weakest"), _gumbel(seed, "doc_id", "text").alias("noise"))
    slim = saved(slim)
    asked = docs.sparkSession.createDataFrame([(i,) for i in aside], "doc_id long")
    own = slim.join(asked, "doc_id", "left_semi")
    floors = own.agg(*(F.percentile(F.col("weakest")[k], F.lit(floor_share)).alias(f"f{k}") for k in range(len(windows)))).first()
    floors = tuple(0.0 if f is None else float(f) for f in floors)
    log_weight = _log_weight(F.col("weakest"), floors)
    rows = slim.select("doc_id", log_weight.alias("log_weight"), (log_weight / temperature + F.col("noise")).alias("key"))
    k = rows.where("log_weight >= 0").count() if any(picked.values()) else 0
    return Scored(rows, ratios, windows, floors, temperature, seed, kth_largest(rows, "key", k) if k else None)


def _log_weight(weakest: Column, floors: tuple[float, ...]) -> Column:
    excess = [weakest[k] - F.lit(f) for k, f in enumerate(floors)]
    return F.least(*excess) if len(excess) > 1 else excess[0]
