"""An embedder learnt from the corpus: words that keep the same company lie near each other.

Spark counts which words of a bounded vocabulary stand within a window of each other, in all documents. What that says beyond chance
(positive pointwise mutual information) is a sparse symmetric matrix, a table of cells, whose leading eigenvectors a randomised range
finder gets from three products with a thin dense matrix. Products run in tasks, over cells; the dense matrices have a row for each word of the
vocabulary and a column for each dimension (2^16 x 72 floats at most by default), so driver and broadcasts are bounded whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .lexical import words
from .models import EMBEDDING_PREFIX

#: Words of the vocabulary at most, letters of such a word at most, documents that must have it, words to either side that count as its company.
WORDS, LETTERS, DOCUMENTS, WINDOW = 1 << 16, 64, 3, 4
#: Pairs whose counts a task holds before they are shuffled.
HELD = 1 << 21
#: Columns of the range finder beyond the dimensions asked for.
SPARE = 8
_WORD = re.compile(r"\w+")


def vocabulary(documents: DataFrame, text: str = "text", least: int = DOCUMENTS, most: int = WORDS) -> DataFrame:
    """(word, id, n): the ``most`` words that the most documents have, n each, ``least`` or more; ids from 0, by falling n, then by the word."""
    listed = documents.select(F.explode(F.array_distinct(words(text))).alias("word"))
    found = listed.where(F.length("word") <= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = found.orderBy(F.desc("n"), "word").limit(most)
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).alias("id"), "n")


def company(documents: DataFrame, known: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(a, b, n), a <= b: how often words ``known`` (word, id) stand within ``window`` of each other. Other words keep their places.

    Words become ids in map tasks, and pairs are counted there first: what is shuffled are counts of pairs of ids. The words are
    sent to all tasks (bounded by the vocabulary); a task holds ``HELD`` pairs and one batch's at most.
    """
    spark = documents.sparkSession
    listed = pa.array([r.word for r in known.orderBy("id").select("word").collect()], pa.string())
    sent, size = spark.sparkContext.broadcast(listed), max(1, len(listed))

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def met(words: pa.Array) -> np.ndarray:
        """The pairs of a batch of lists of words, as numbers."""
        flat = words.flatten()
        ids = pc.fill_null(pc.index_in(flat, value_set=sent.value.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        pairs = [np.zeros(0, np.int64)]
        for k in range(1, window + 1):
            x, y = ids[:-k], ids[k:]
            good = (row[:-k] == row[k:]) & (x >= 0) & (y >= 0)
            x, y = x[good], y[good]
            pairs.append(np.minimum(x, y) * size + np.maximum(x, y))
        return np.concatenate(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((some // size).astype(np.int32)), pa.array((some % size).astype(np.int32)), pa.array(n[at : at + (1 << 16)])], ["a", "b", "n"])

        none = np.zeros(0, np.int64)
        held, parts = (none, none), []
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            parts.append(np.unique(met(batch.column(0)), return_counts=True))
            if sum(len(k) for k, _ in parts) >= HELD // 4:
                held, parts = summed(*(np.concatenate(x) for x in zip(held, *parts, strict=True))), []
                if len(held[0]) >= HELD:
                    yield from told(*held)
                    held = none, none
        yield from told(*summed(*(np.concatenate(x) for x in zip(held, *parts, strict=True))))

    counted = documents.select(words(text).alias("w")).where(F.size("w") > 1).mapInArrow(run, "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def information(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n, pmi), both ways round, for the pairs of ``company`` met ``least`` times or more that keep company beyond chance.

    n is the entry of the symmetric table of counts: a pair of one word with itself counts twice, once for each side.
    """
    both = pairs.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("n") * 2).otherwise(F.col("n")).alias("n"))
    both = both.unionByName(both.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    sums = both.groupBy("a").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").cast("double").alias("t")).select("t").scalar()
    of = lambda side: F.broadcast(sums.select(F.col("a").alias(side), F.col("s").alias(f"_{side}")))
    told = both.where(F.col("n") >= least).join(of("a"), "a").join(of("b"), "b").withColumn("_t", total)
    pmi = F.log(F.col("n") * F.col("_t") / (F.col("_a").cast("double") * F.col("_b")))
    return told.select("a", "b", "n", pmi.alias("pmi")).where("pmi > 0")


def associations(documents: DataFrame, text: str = "text", k: int = 5, least: int = 3) -> DataFrame:
    """(word, other, n, pmi, rank): of each word of the vocabulary the ``k`` whose company says most, met ``least`` times or more."""
    known = vocabulary(documents, text).checkpoint()
    cells = information(company(documents, known, text).checkpoint(), least).withColumn("pmi", F.round("pmi", 6))
    name = lambda side, to: F.broadcast(known.select(F.col("id").alias(side), F.col("word").alias(to)))
    told = cells.join(name("a", "word"), "a").join(name("b", "other"), "b")
    nth = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("pmi"), F.desc("n"), "other"))
    return told.select("word", "other", "n", "pmi", nth.alias("rank")).where(F.col("rank") <= k)


def _product(cells: DataFrame, by: np.ndarray) -> np.ndarray:
    """The matrix of ``cells`` (a, b, pmi; rows together, in order) times ``by``: tasks send a row for each of theirs, no matter how many cells it has."""
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast(by.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, open_row, held = sent.value, None, None
        row_of = lambda ids, rows: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["a", "row"])
        for batch in batches:
            a, b, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(a):
                continue
            at = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
            sums, ids = np.add.reduceat(weight[:, None] * x[b], at, axis=0), a[at]
            if open_row == ids[0]:
                sums[0] += held
            elif open_row is not None:
                yield row_of([open_row], [held])
            if len(ids) > 1:
                yield row_of(ids[:-1], sums[:-1])
            open_row, held = ids[-1], sums[-1]
        if open_row is not None:
            yield row_of([open_row], [held])

    got = cells.mapInArrow(run, "a long, row array<double>").toArrow()
    sent.destroy()
    out = np.zeros(by.shape)
    np.add.at(out, got["a"].to_numpy(), got["row"].combine_chunks().flatten().to_numpy().reshape(-1, by.shape[1]))
    return out


def leading(cells: DataFrame, size: int, dims: int, seed: int = 7) -> np.ndarray:
    """size x dims: the eigenvectors of the symmetric matrix of ``cells`` whose eigenvalues are largest in size, times their roots; zeros where it has fewer."""
    width = min(size, dims + SPARE)
    basis = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(2):
        basis, _ = np.linalg.qr(_product(cells, basis))
    small = basis.T @ _product(cells, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-np.abs(values), kind="stable")[:dims]
    out = np.zeros((size, dims))
    out[:, : len(best)] = (basis @ turned[:, best]) * np.sqrt(np.abs(values[best]))
    return out


@dataclass(frozen=True)
class LearntWords:
    """An embedder: the weighted sum of a text's words. A word's vector is half its company's and half its own name's, a word outside the vocabulary is its name alone."""

    rows: dict[str, int]
    weights: np.ndarray
    vectors: np.ndarray
    rarest: float

    def embed(self, texts: list[str]) -> np.ndarray:
        dims = self.vectors.shape[1]
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in _WORD.findall(text.removeprefix(EMBEDDING_PREFIX).lower()):
                k = self.rows.get(word)
                row += self.rarest * _name(word, dims) if k is None else self.weights[k] * self.vectors[k]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


def _name(word: str, dims: int) -> np.ndarray:
    """A direction that only the word's letters decide."""
    drawn = hashlib.shake_128(word.encode("utf-8", "surrogatepass")).digest((dims + 7) // 8)
    return (np.unpackbits(np.frombuffer(drawn, np.uint8))[:dims] * 2.0 - 1) / np.sqrt(dims)


@dataclass(frozen=True)
class Learnt:
    """What was learnt of a corpus of ``documents``: for each word of the vocabulary in how many it is, and its vector."""

    spark: SparkSession
    documents: int
    words: list[str]
    n: np.ndarray
    vectors: np.ndarray

    def model(self) -> Callable[[], LearntWords]:
        """For ``index.embed``: workers get it once, by a broadcast."""
        weights = np.log((self.documents + 1) / self.n)
        held = LearntWords({w: k for k, w in enumerate(self.words)}, weights, self.vectors, float(np.log(self.documents + 1)))
        sent = self.spark.sparkContext.broadcast(held)
        return lambda: sent.value

    def write(self, path: str) -> None:
        rows = [(w, int(n), v.tolist(), self.documents) for w, n, v in zip(self.words, self.n, self.vectors, strict=True)]
        self.spark.createDataFrame(rows, "word string, n long, vector array<double>, documents long").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> Learnt:
    """What ``Learnt.write`` has written; an empty vocabulary is read as one of a corpus of nothing."""
    rows = spark.read.parquet(path).orderBy(F.desc("n"), "word").collect()  # bounded by the vocabulary
    dims = len(rows[0].vector) if rows else 1
    return Learnt(spark, rows[0].documents if rows else 0, [r.word for r in rows], np.array([r.n for r in rows], float), np.array([r.vector for r in rows], float).reshape(-1, dims))


def learn(documents: DataFrame, text: str = "text", dims: int = 64, least: int = DOCUMENTS, most: int = WORDS, window: int = WINDOW) -> Learnt:
    """Learns from all ``documents``: null and empty texts have no words, an empty table none at all, and every word is then its name alone."""
    known = vocabulary(documents, text, least, most).checkpoint()
    listed = known.orderBy("id").collect()  # bounded by ``most``
    cells = information(company(documents, known, text, window).checkpoint()).select("a", "b", "pmi")
    cells = cells.repartition("a").sortWithinPartitions("a", "b").checkpoint()
    n = np.array([r.n for r in listed], float)
    found = leading(cells, len(listed), dims) if listed else np.zeros((0, dims))
    size = lambda m: np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
    found /= size(found)
    if len(n):
        found -= np.average(found, axis=0, weights=n) * (np.linalg.norm(found, axis=1, keepdims=True) > 0)
        found /= size(found)
    names = np.array([_name(r.word, dims) for r in listed]).reshape(-1, dims)
    both = found + names
    return Learnt(documents.sparkSession, documents.count(), [r.word for r in listed], n, both / size(both))
