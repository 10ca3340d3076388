"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is laid over every word of a text.  Three
measures tell prose from noise: characters per token, share of byte-fallback tokens and
the entropy of the tokens.  A document outside the band of its script and length is
rejected; so is one that fails the plain word rules.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.common import arrow_rows, doc_texts, documents, vocabulary, worker_table
from loomsift.llm.tokens import WordIds

PIECE_BPE = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Entropy is a share of that of so many equally frequent tokens (fewer in shorter texts), so length does not lower it.
ENTROPY_TOKENS = 1024


@dataclass(frozen=True)
class Band:
    """Accepted characters per token, most byte-fallback share, least entropy (a share).

    A mean over n tokens strays by about one over the root of n: ``low`` gives way by ``slack`` over it.
    """

    low: float
    high: float
    byte_share: float
    entropy: float
    slack: float = 0.0

    def least(self, n_tokens: int) -> float:
        return self.low - self.slack / math.sqrt(n_tokens)


#: By script of most letters.  "accented" is Latin with many letters beyond ASCII, which cost more tokens.
#: Latin: prose of sf0.1 of 500 tokens and more has at least 1.76, random letters have 1.55, base64 1.2, hex 1.0.
#: The others lie between a declaration's text and random letters of the script.  Of "other" (and of Greek and
#: Hebrew, spelled letter by letter) prose and random letters measure the same.
BANDS = {
    "latin": Band(1.75, 8.0, 0.15, 0.40, 1.5),
    "accented": Band(0.9, 8.0, 0.25, 0.40, 0.5),
    "cyrillic": Band(1.35, 8.0, 0.20, 0.40, 1.0),
    "greek": Band(0.7, 6.0, 0.40, 0.40),
    "hebrew": Band(0.7, 6.0, 0.30, 0.40),
    "arabic": Band(0.7, 6.0, 0.30, 0.40),
    "armenian": Band(0.72, 6.0, 0.32, 0.35, 0.3),
    "devanagari": Band(0.65, 6.0, 0.30, 0.35, 0.4),
    "tamil": Band(0.6, 6.0, 0.40, 0.35, 0.4),
    "thai": Band(0.7, 6.0, 0.20, 0.35, 0.4),
    "georgian": Band(0.76, 6.0, 0.20, 0.35, 0.3),
    "han": Band(0.45, 4.0, 0.45, 0.35, 0.3),
    "other": Band(0.2, 6.0, 0.95, 0.30),
}
#: Latin texts with at least this share of letters beyond ASCII are judged as "accented".
ACCENTED = 0.12
# First code points of the blocks that tell the scripts apart.
_BLOCKS = [(0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x700, "other"), (0x900, "devanagari"), (0x980, "other"), (0xB80, "tamil"), (0xC00, "other"), (0xE00, "thai"), (0xE80, "other"),
           (0x10A0, "georgian"), (0x1100, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "han"), (0xA000, "other"),
           (0xAC00, "han"), (0xD7B0, "other")]
_SCRIPT_STARTS = np.array([start for start, _ in _BLOCKS])
_SCRIPT_NAMES = [name for _, name in _BLOCKS]


class PieceWords(WordIds):
    """Pieces of a word by a SentencePiece model (each word as after a space)."""

    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        super().__init__(limit)

    def ids_of(self, word: bytes) -> list[int]:
        return self.model.encode(word.decode())


def piece_words(path: str) -> PieceWords:
    """The pieces table of this worker."""
    return worker_table(("pieces", path), lambda: PieceWords(path))


def repeated_words(rows: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more."""
    n = len(rows) - size + 1
    if n < 2:
        return 0
    # Ranks of windows of growing size; each step pairs two ranks without a collision.
    width, done = 1, {1: np.unique(rows, return_inverse=True)[1].astype(np.int64)}
    while width * 2 <= size:
        a = done[width]
        pair = a[:len(a) - width] * (int(a.max()) + 1) + a[width:]
        width *= 2
        done[width] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = done[width]
    if width < size:
        last = done[width][size - width:size - width + n]
        code = code[:n] * (int(code.max()) + 1) + last
    _, inverse, counts = np.unique(code[:n], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(rows) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def base_measures(text: str, words: list[bytes], rows: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x and not x.isspace() or x.strip(BLANKS)]
        dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, repeated_words(rows)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def script_of(text: str) -> str:
    """Script of most letters; ASCII text is Latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = points[points >= 0x80]
    letters = int((((points | 32) >= 97) & ((points | 32) <= 122)).sum())
    count = Counter({"latin": letters})
    block, n = np.unique(np.searchsorted(_SCRIPT_STARTS, upper, "right") - 1, return_counts=True)
    for b, k in zip(block.tolist(), n.tolist(), strict=True):
        count[_SCRIPT_NAMES[b]] += k
    return max(sorted(count), key=lambda s: count[s])


def fertility(word_chars: int, ids: np.ndarray, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """n_tokens, characters per token, byte-fallback share, entropy as a share."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    _, counts = np.unique(ids, return_counts=True)
    share = counts / n
    entropy = float(-(share * np.log2(share)).sum())
    return n, word_chars / n, float(is_byte[ids].mean()), entropy / math.log2(min(n, ENTROPY_TOKENS)) if n > 1 else 0.0


def accented(text: str) -> bool:
    """Whether many letters of a Latin text are beyond ASCII."""
    if text.isascii():
        return False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = int((((points | 32) >= 97) & ((points | 32) <= 122)).sum())
    beyond = int((((points >= 0xC0) & (points < 0x370)) | ((points >= 0x1E00) & (points < 0x1F00))).sum())
    return beyond > 0 and beyond >= ACCENTED * (plain + beyond)


def verdict(script: str, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float,
            bands: dict[str, Band] = BANDS) -> bool:
    """Whether a text is inside the band of its script, whatever its length; one without tokens is not."""
    band = bands.get(script, bands["other"])
    return (n_tokens > 0 and band.least(n_tokens) <= chars_per_token <= band.high and byte_share <= band.byte_share
            and entropy >= band.entropy)


MEASURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy double")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
                     ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("n_tokens", pa.int64()),
                     *((n, pa.float64()) for n in "chars_per_token byte_share entropy".split())])


def measure(text: str, pieces: PieceWords, bands: dict[str, Band] = BANDS) -> tuple:
    words = text.encode().split()
    rows = pieces.rows(words)
    base = base_measures(text, words, rows)
    failed = base_failed(base[0], base[4])
    script = script_of(text)
    found = fertility(base[1], pieces.gather(rows), pieces.is_byte)
    band = "accented" if script == "latin" and "accented" in bands and accented(text) else script
    return (*base, failed, not failed and verdict(band, *found, bands), script, *found)


def quality_measures(docs: DataFrame, vocab: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Measures and verdict of every document.

    A null text has no words and fails.  Null doc_ids and repeated rows keep their rows;
    other columns are not used.
    """
    def rows(batch):
        pieces = piece_words(vocab)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield (doc_id, *measure(text, pieces, bands))

    return doc_texts(docs).mapInArrow(arrow_rows(rows, _SCHEMA), MEASURES)


def keep_good(docs: DataFrame, vocab: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows whose verdict is to keep, with all their columns."""
    at = docs.columns.index("text")

    def good(batches):
        pieces = piece_words(vocab)
        for batch in batches:
            keep = [measure(t or "", pieces, bands)[6] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_measures(documents(spark, sf_dir), vocabulary(PIECE_BPE))
