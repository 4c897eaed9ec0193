"""Hierarchical packing of token ids into windows of several lengths.

Each document is routed by its length: whole windows of the longest tier are cut off, the rest goes
to the shortest tier that holds it. Each tier's windows are opened by its own pieces and their gaps
filled from shorter tiers, largest fitting piece first; the last gap is filled by cutting a piece.
So every window is full, but for at most one in each task, which lacks less than the shortest tier.
Windows are then dealt to step groups of like token counts and like attention cost.

Tasks pack what they scan, window of documents by window of documents: nothing is shuffled, and a
task that runs anew makes the same windows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import MAX_WORDS, WordEncoder

TIERS = (2048, 1024, 512, 256, 128)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

#: (length, document, start): a run of a document's ids.
Piece = tuple[int, int, int]


def fill(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces), and the pieces left over: fewer ids than the shortest tier has."""
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[Piece] = []
    for n, doc, start in pieces:
        for at in range(start, start + n - tiers[0] + 1, tiers[0]):
            windows.append((tiers[0], [(tiers[0], doc, at)]))
        if n % tiers[0]:
            pool.append((n % tiers[0], doc, start + n - n % tiers[0]))
    pool.sort()
    for k, tier in enumerate(tiers):
        shorter = tiers[k + 1] if k + 1 < len(tiers) else 0
        while pool and pool[-1][0] > shorter:
            window, gap = [], tier
            while gap and pool:
                k = bisect_right(pool, (gap, float("inf"), 0)) - 1
                if k >= 0:
                    window.append(pool.pop(k))
                else:
                    n, doc, start = pool.pop(0)
                    window.append((gap, doc, start))
                    insort(pool, (n - gap, doc, start + gap))
                gap -= window[-1][0]
            if gap:
                for piece in window:
                    insort(pool, piece)
                break
            windows.append((tier, window))
    return windows, pool


def _last(pieces: list[Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """Windows for all that a task has left: full ones, but for at most one of the longest tier."""
    windows, least = [], tiers[-1]
    total, order = sum(p[0] for p in pieces), sorted(pieces, reverse=True)
    longest = tiers[0]
    odd = total % least
    sizes: list[int] = []
    rest = total
    if odd:
        # One window is padded: as long as the ids allow, so that it lacks little.
        sizes.append(min(total, longest - least + odd))
        rest -= sizes[0]
    for tier in tiers:
        sizes += [tier] * (rest // tier)
        rest %= tier
    for size in sizes:
        window, gap = [], size
        while gap:
            n, doc, start = order.pop()
            take = min(n, gap)
            window.append((take, doc, start))
            if take < n:
                order.append((n - take, doc, start + take))
            gap -= take
        windows.append((longest if size & (size - 1) else size, window))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], group_tokens: int) -> list[int]:
    """A group for each window: tokens alike first, then the sum of squared piece lengths."""
    total = sum(tier for tier, _ in windows)
    groups = [(0, 0, g) for g in range(max(1, round(total / group_tokens)))]
    out = [0] * len(windows)
    cost = lambda w: sum(p[0] ** 2 for p in w)
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][0], -cost(windows[k][1]))):
        tokens, squares, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (tokens + windows[k][0], squares + cost(windows[k][1]), g))
    return out


class _Packer:
    """One task: holds the ids of a window of documents."""

    def __init__(self, task: int, tiers: tuple[int, ...], group_tokens: int) -> None:
        self.tiers, self.group_tokens = tiers, group_tokens
        self.next_sequence = self.next_group = task << 40
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.left: list[Piece] = []
        self.first = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)

    def flush(self, last: bool = False) -> pa.RecordBatch:
        pieces = self.left + [(len(ids), self.first + k, 0) for k, (_, ids) in enumerate(self.docs[self.first :]) if len(ids)]
        if last:
            windows, left = fill(pieces, self.tiers)
            spare = sum(p[0] for p in left)
            if spare and (whole := next((k for k in range(len(windows)) if windows[k][0] == self.tiers[0]), None)) is not None:
                left += windows.pop(whole)[1]
            windows += _last(left, self.tiers)
            left = []
        else:
            windows, left = fill(pieces, self.tiers)
        groups = step_groups(windows, self.group_tokens)
        rows: list[list] = [[] for _ in range(9)]
        for (tier, window), group in zip(windows, groups, strict=True):
            offset = 0
            for n, doc, start in window:
                doc_id, ids = self.docs[doc]
                row = doc_id, start, n, ids[start : start + n].tobytes(), len(ids), self.next_sequence, offset, tier, self.next_group + group
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
                offset += n
            self.next_sequence += 1
        self.next_group += max(groups, default=-1) + 1
        # Documents that still have ids to place move to the front.
        keep = sorted({doc for _, doc, _ in left})
        at = {doc: k for k, doc in enumerate(keep)}
        self.docs = [self.docs[doc] for doc in keep]
        self.left = [(n, at[doc], start) for n, doc, start in left]
        self.first, self.tokens = len(keep), 0
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, *, end: tuple[int, ...] = (1,), tiers: tuple[int, ...] = TIERS, window_tokens: int = 1 << 20, group_tokens: int = 1 << 15, max_words: int = MAX_WORDS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows: the columns of ``SCHEMA``, ids as little-endian unsigned 32-bit.

    ``tiers`` are powers of two, longest first; ``tokenizer`` is a file for ``WordEncoder``; ``end``
    follows each document's ids. A window that isn't full has the longest tier. Null and empty texts
    have the ids ``end`` only, and none, hence no piece, if ``end`` is empty. Repeated rows and null
    doc_ids are packed like others; ``max_words`` bounds the words that a worker keeps the ids of, which
    trades its memory for time; ``sequence_id`` is unique over tasks. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tail = np.array(end, "<u4").tobytes()
        encoder, packer = WordEncoder.of(tokenizer, max_words), _Packer(TaskContext.get().partitionId(), tiers, group_tokens)
        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encoded(texts), strict=True):
                packer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
                if packer.tokens >= window_tokens:
                    yield packer.flush()
        yield packer.flush(last=True)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)
