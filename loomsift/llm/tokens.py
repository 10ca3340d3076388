"""Exact token ids of whole texts from a table of encoded words.

The vocabulary drops white space and splits at it, so a text's ids are the ids of its
words in order.  A word is encoded once per worker and looked up afterwards; the table
is bounded and starts anew when full.  The tokenizers library gives every id: through
its model for plain words, through its whole pipeline for any other.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

from loomsift.llm.common import worker_table

WORD_BPE = "word_bpe_49k.json"
TABLE_WORDS = 500_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class WordIds(dict):
    """Word (UTF-8) to row number; ``flat[starts[row]:starts[row + 1]]`` are its ids."""

    def __init__(self, limit: int = TABLE_WORDS):
        super().__init__()
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.flat = array("I")
        self.starts = array("q", [0])

    def ids_of(self, word: bytes) -> Sequence[int]:
        raise NotImplementedError

    def __missing__(self, word: bytes) -> int:
        row = len(self.starts) - 1
        self.flat.extend(self.ids_of(word))
        self.starts.append(len(self.flat))
        self[word] = row
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self._reset()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after another (unsigned 32 bit)."""
        if not len(rows):
            return np.empty(0, np.uint32)
        starts = np.frombuffer(self.starts, np.int64)
        first, size = starts[rows], starts[rows + 1] - starts[rows]
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
        return np.frombuffer(self.flat, np.uint32)[at] if ends[-1] else np.empty(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.gather(self.rows(text.encode().split()))


class BpeWords(WordIds):
    """Ids of the word BPE (lower case, end-of-word marks, white space dropped)."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, tuple[int, ...]] = {}
        self.stand_in = _byte_chars()
        # Fixed: the split of this vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = re.compile(r"(?!.*<\|)[!-~\xc0-\u012f\u0139-\u017e]{1,200}").fullmatch
        super().__init__(limit)

    def _reset(self) -> None:
        super()._reset()
        self.parts.clear()

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            chars = part if part.isascii() else "".join([self.stand_in[b] for b in part.encode()])
            ids = self.parts[part] = tuple([t.id for t in self.model.tokenize(chars)])
        return ids

    def ids_of(self, word: bytes) -> Sequence[int]:
        text = word.decode()
        low = text.lower()
        # Letters of these blocks are lower-cased and composed alone, whatever stands beside them.
        if not self.plain(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if low.isalpha():
            return self._part(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self._part(low[:-1]) + self._part(low[-1])
        return [i for part in self.split.findall(low) for i in self._part(part)]


def bpe_words(path: str) -> BpeWords:
    """The encoder of this worker."""
    return worker_table(("bpe", path), lambda: BpeWords(path))
