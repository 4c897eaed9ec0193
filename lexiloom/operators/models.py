"""Models behind small interfaces, and deterministic substitutes that need no download.

The substitutes are for tests and for wiring a plan: their quality says nothing about real models.
Real ones implement the same methods; they are built once in each worker, at their first batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from typing import Protocol

import numpy as np

#: Put before queries and documents alike. Fixed value.
EMBEDDING_PREFIX = "Represent this sentence for searching relevant passages: "
_WORD = re.compile(r"\w+")
#: For ``bytes.translate``: what is no letter of an ASCII word is a space.
_GAPS = bytes(b if re.match(rb"\w", bytes([b])) else 32 for b in range(256))


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of unit length for each text."""


class Scorer(Protocol):
    def score(self, queries: list[str], documents: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, system: list[str], prompts: list[str]) -> list[str]: ...


class Judge(Protocol):
    def judge(self, question: str, answer: str, contexts: list[str], reference: str) -> tuple[float, float, float]:
        """Faithfulness of the answer to the contexts, its relevance to the question, precision of the contexts: 0 to 1 each."""


def _words(text: str) -> Iterable[bytes]:
    """The words of ``_WORD``, in UTF-8; ASCII is cut without a pattern, which is slow."""
    return text.encode().translate(_GAPS).split() if text.isascii() else map(str.encode, _WORD.findall(text))


class HashedWords:
    """Substitute embedder: signed hashed word counts, normalised."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float64)
        for row, text in zip(out, texts, strict=True):
            h = np.fromiter(map(zlib.crc32, _words(text.removeprefix(EMBEDDING_PREFIX).lower())), np.int64)
            counts = np.bincount(h % self.dims + self.dims * (h >> 16 & 1), minlength=2 * self.dims)
            row += counts[self.dims :] - counts[: self.dims]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


class SharedWords:
    """Substitute scorer: the share of the query's words that the document has."""

    def score(self, queries: list[str], documents: list[str]) -> list[float]:
        pairs = ((set(_WORD.findall(q.lower())), set(_WORD.findall(d.lower()))) for q, d in zip(queries, documents, strict=True))
        return [len(q & d) / len(q) if q else 0.0 for q, d in pairs]


class FirstSource:
    """Substitute generator: the first sentence of the first source, cited."""

    def generate(self, system: list[str], prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            block = prompt.partition("[Source 1]")[2].partition("[Source 2]")[0].partition("\n\nQuestion: ")[0].strip()
            body = block.partition("Content type:")[2].partition("\n")[2].strip() or block
            out.append(f"{re.split(r'(?<=[.!?])\s', body)[0]} [Source 1]")
        return out


class SharedWordsJudge:
    """Substitute judge: shares of words. Precision is the mean share of good contexts down to each good one; one is good that has half of the reference's words."""

    def judge(self, question: str, answer: str, contexts: list[str], reference: str) -> tuple[float, float, float]:
        asked, said, wanted = (set(_WORD.findall(t.lower())) for t in (question, answer, reference))
        given = [set(_WORD.findall(c.lower())) for c in contexts]
        share = lambda of, among: len(of & among) / len(of) if of else 0.0
        good = [share(wanted, c) >= 0.5 for c in given]
        ranks = [sum(good[: k + 1]) / (k + 1) for k, fine in enumerate(good) if fine]
        return share(said, set().union(*given)), share(asked, said), sum(ranks) / len(ranks) if ranks else 0.0
