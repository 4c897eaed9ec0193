"""Token ids of whole texts, by words.

The vocabulary's normaliser and splitter never look across white space, so a text's ids are the ids
of its words. Words repeat, hence each worker keeps the ids of recent ones in a bounded table, and
the new words of many texts are encoded in one call.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

_CONTROL = re.compile("[\x1c-\x1f]")  # white space for str.split() but not for the tokenizer
_MARK = "\x01"
#: Bytes as the characters of byte-level vocabularies: printable ones are themselves, others follow 255 in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = str.maketrans({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)})
#: Words that a worker keeps, once over for recent ones and once for older ones: some 200 bytes each.
MAX_WORDS = 800_000
_encoders: dict[tuple[str, int], "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """For tokenizer files whose words are independent: white space dropped, no merges across it. Others are an error.

    Such files also split a word between a letter or digit and the mark that follows it, and ignore
    case where ``lower`` is true; a new word is then put together from the word without them.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_length: int = 64, chars: int = 1 << 17) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._split: dict[tuple[str, str], bool] = {}
        self._max_words, self._max_length, self._chars = max_words, max_length, chars
        alone = lambda text: self._tokenizer.encode(text, add_special_tokens=False).ids
        parts = "then", "Th\u00e8se,", "\u00fcber", "12", "a", "\u0434\u0430", "don't."
        if any(alone(text) != [x for p in parts for x in alone(p)] for text in (" ".join(parts), "  " + " \n\t".join(parts) + " ")):
            raise ValueError(f"{path}: the ids of a text aren't those of its words one by one")
        mark = alone(_MARK)
        self._mark = mark[0] if len(mark) == 1 else None
        self._tails = {c: self._encode(c) for c in ",." if alone(f"tion{c}") == [*alone("tion"), *alone(c)] and alone(f"T9{c}") == [*alone("T9"), *alone(c)]}
        self._lower = alone("\u00c9Tion \u00c4B") == alone("\u00e9tion \u00e4b")

        self._model = self._tokenizer.model
        tried = "then", "th\u00e8se", "\u00fcber\u00dfng", "ni\u00f1oqueasd", "a", "\u0434\u0430"
        self._direct = all(self._letters(w) == self._encode(w) for w in tried)

    @classmethod
    def of(cls, path: str, max_words: int = MAX_WORDS) -> "WordEncoder":
        """The worker's encoder for this file."""
        if (path, max_words) not in _encoders:
            _encoders[path, max_words] = cls(path, max_words)
        return _encoders[path, max_words]

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a word of lower-case letters, by the model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _parts(self, letter: str, mark: str) -> bool:
        """Whether the mark is split off after this letter. Some end in an accent of their own in lower case, which it stays with."""
        if letter.isascii():
            return True
        if (letter, mark) not in self._split:
            self._split[letter, mark] = all(self._encode(f"{w}{letter}{mark}") == self._encode(f"{w}{letter}") + self._tails[mark] for w in ("", "ab"))
        return self._split[letter, mark]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of new words into the table: those that aren't plain are found together, a mark between them."""
        known, older, tails = self._known, self._older, self._tails
        todo: dict[str, list[tuple[str, bytes]]] = {}
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            if self._mark is None or len(w) > self._max_length or _MARK in w:
                known[w] = self._encode(w)
                continue
            base, tail = w, b""
            if w[-1] in tails and (b := w[:-1]).isalpha() and (b[-1].isascii() or self._parts(b[-1], w[-1])):
                base, tail = b, tails[w[-1]]
            if base.isalpha():
                if not base.islower() and self._lower and "\u0130" not in base and "\u03a3" not in base:
                    base = base.lower()
                if base is not w and (ids := known.get(base) or older.get(base)):
                    known[base], known[w] = ids, ids + tail
                    continue
                if self._direct and base.islower() and (base.isascii() or unicodedata.is_normalized("NFC", base)):
                    known[base] = ids = self._letters(base)
                    known[w] = ids + tail
                    continue
            todo.setdefault(base, []).append((w, tail))
        if todo:
            raw = self._encode(f" {_MARK} ".join(todo))
            ends = (np.flatnonzero(np.frombuffer(raw, "<u4") == self._mark) * 4).tolist()
            for (base, own), a, b in zip(todo.items(), [0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True):
                known[base] = raw[a:b]
                for w, tail in own:
                    known[w] = raw[a:b] + tail

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        known = self._known
        get = known.get
        split = [None if _CONTROL.search(t) else t.split() for t in texts]
        found = [words and [get(w) for w in words] for words in split]
        if new := {w for words, ids in zip(split, found, strict=True) if words and None in ids for w, x in zip(words, ids, strict=True) if x is None}:
            self._learn(new)
        for text, words, ids in zip(texts, split, found, strict=True):
            if words is None:
                yield self._encode(text)
            elif new and None in ids:
                yield b"".join([known[w] if x is None else x for w, x in zip(words, ids, strict=True)])
            else:
                yield b"".join(ids)
        if len(known) > self._max_words:
            self._known, self._older = {}, known

    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text counts as empty."""
        batch: list[str] = []
        chars = 0
        for text in texts:
            batch.append(text or "")
            chars += len(batch[-1])
            if chars >= self._chars:
                yield from list(self._batch(batch))
                batch, chars = [], 0
        yield from list(self._batch(batch))
