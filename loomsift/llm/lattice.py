"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is cut where no piece can reach across: before runs of word marks and around line
ends.  For each part the lattice of pieces is filtered forward once (the probability of
all segmentations up to each position) and kept.  Every occurrence then draws its
segmentation backward, from its end to its start, one piece at a time, with numbers that
depend only on the row's key, the place of the part in the text and the step: the same
row gets the same segmentation in any task.

A piece weighs its share under ``1 / (rank + OFFSET)``, the rank being its order in the
vocabulary file, to the power of ``sharpness``.  Characters without a piece are spelt in bytes, so
decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.common import arrow_rows, doc_texts, documents, vocabulary, worker_table
from loomsift.llm.quality import PIECE_BPE

MARK = "▁"
#: Stands for a space inside: a lone surrogate, which no valid text holds, so a mark in a text stays one.
SPACE = "\ud800"
OFFSET = 10.0
SHARPNESS = 0.4
SEED = 1
KEPT_PARTS = 300_000
BATCH_CHARS = 4_000_000


class Pieces:
    """Pieces of a model: ids by text, weights, bytes for decoding."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        self.id: dict = {}  # ids in the order of rank, then with weights
        rank = 0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} reaches across the start of a word")
                self.id[piece.replace(MARK, SPACE)] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                rank += 1
        total = sum(1 / (r + OFFSET) for r in range(rank))
        # Weights are shares to the power of the sharpness: below 1, rarer segmentations come up more often.
        self.id = {p: (i, (1 / (r + OFFSET) / total) ** sharpness) for r, (p, i) in enumerate(self.id.items())}
        self._grow_trie()
        #: Ids of each symbol: a piece, or the bytes of a character.
        self.symbols: list[tuple[int, ...]] = [(i,) for i in range(size)]
        self.spelt: dict[bytes, int] = {}
        self.longest = max(map(len, self.id), default=1)
        ends = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id))
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|[{ends}]+" if ends else "")).findall

    def _grow_trie(self) -> None:
        """Prefixes of pieces as nodes; a step is a node and the number of a character that some piece has."""
        self.number_of = np.zeros(0x110000, np.int64)
        for n, char in enumerate(sorted({c for p in self.id for c in p}), 1):
            self.number_of[ord(char)] = n
        self.width = int(self.number_of.max()) + 1
        node, steps = {"": 0}, []
        for piece in self.id:
            for k, char in enumerate(piece, 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(node)
                    steps.append((node[piece[:k - 1]] * self.width + int(self.number_of[ord(char)]), node[piece[:k]]))
        steps.append((len(node) * self.width, 0))  # beyond every step
        self.step, self.step_to = np.array(sorted(steps), np.int64).T.copy()
        self.piece_at = np.full(len(node), -1, np.int64)
        self.weight_at = np.zeros(len(node))
        for piece, (i, weight) in self.id.items():
            self.piece_at[node[piece]], self.weight_at[node[piece]] = i, weight

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the text: start, length, symbol and weight, in the order of their ends, the longest first.

        ``left`` is how many characters of its part stand at and after each place.
        """
        numbers = self.number_of[codes]
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        length = 0
        while len(at):
            # Starts go on only while some piece has their prefix.
            key = node * self.width + numbers[at + length]
            step = np.searchsorted(self.step, key)
            on = self.step[step] == key
            at, node = at[on], self.step_to[step[on]]
            length += 1
            ends = np.flatnonzero(self.piece_at[node] >= 0)
            found.append((at[ends], np.full(len(ends), length), self.piece_at[node[ends]], self.weight_at[node[ends]]))
            more = left[at] > length
            at, node = at[more], node[more]
        single = np.ones(len(codes), bool)
        single[found[0][0]] = False
        spelt = np.flatnonzero(single)
        names = np.array([self.symbol_of_char(chr(c)) for c in codes[spelt].tolist()], np.int64)
        found.append((spelt, np.ones(len(spelt), np.int64), names, np.ones(len(spelt))))
        start, size, symbol, weight = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort((start + size) * (self.longest + 1) - size)
        return start[order], size[order], symbol[order], weight[order]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids; the space in front, which encoding adds, goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]

    def symbol_of_char(self, char: str) -> int:
        """The symbol of a character that is no piece: its bytes, side by side."""
        spelt = b" " if char == SPACE else char.encode()
        number = self.spelt.get(spelt)
        if number is None:
            number = self.spelt[spelt] = len(self.symbols)
            self.symbols.append(tuple(self.byte_id[b] for b in spelt))
        return number


class Lattices(dict):
    """Part to its end node; nodes and edges of all kept parts side by side.

    An edge is a piece that ends at its node: the share of the node's probability up to
    it (longest piece first, the last share is 1), the node where the piece starts and
    its symbol.
    """

    def __init__(self, pieces: Pieces, limit: int = KEPT_PARTS):
        super().__init__()
        self.pieces, self.limit = pieces, limit
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.first = array("q")
        self.shares, self.before, self.symbol = array("d"), array("q"), array("q")

    def add(self, parts: list[str]) -> None:
        """Filter new parts forward, all side by side: position by position, each position's edges by rank."""
        pieces = self.pieces
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        stop = np.cumsum(size)
        place = np.arange(len(codes)) - np.repeat(stop - size, size)
        start, length, symbol, weight = pieces.edges(codes, np.repeat(size, size) - place)
        # A node is a position within a part, from 1; it holds the edges that end there.
        counts = np.bincount(start + length - 1, minlength=len(codes))
        first = np.cumsum(counts) - counts
        # Probability up to every position, with one more in front of each part.
        part = np.repeat(np.arange(len(parts)), size)
        forward = np.ones(len(codes) + len(parts))
        source = start + part[start]
        shares = np.empty(len(start))
        total = np.zeros(len(codes))
        by_place = np.argsort(place, kind="stable")
        begin = 0
        for j, many in enumerate(np.bincount(place).tolist(), 1):
            nodes = by_place[begin:begin + many]
            begin += many
            on, rank = nodes, 0
            while len(on):
                edge = first[on] + rank
                total[on] += forward[source[edge]] * weight[edge]
                shares[edge] = total[on]
                rank += 1
                on = on[counts[on] > rank]
            at = nodes + part[nodes] + 1
            forward[at] = total[nodes]
            low = at[total[nodes] < 1e-200]  # only ratios within reach of the longest piece matter
            if len(low):
                for k in range(min(j, pieces.longest) + (j < pieces.longest)):
                    forward[low - k] *= 1e200
        shares /= np.repeat(total, counts)
        shares[first + counts - 1] = 1.0
        node, edge = len(self.first), len(self.shares)
        self.first.frombytes((first + edge).tobytes())
        self.shares.frombytes(shares.tobytes())
        self.before.frombytes(np.where(place[start] > 0, start + node - 1, -1).tobytes())
        self.symbol.frombytes(symbol.tobytes())
        self.update(zip(parts, (stop + node - 1).tolist(), strict=True))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_key(doc_id: int | None, seed: int, sample: int = 0) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{doc_id}|{sample}", seed)


def sampled(lattices: Lattices, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """Ids of a segmentation of each text, drawn with its key."""
    if len(lattices) > lattices.limit:
        lattices.clear_all()
    parts, counts = [], []
    for text in texts:
        some = lattices.pieces.parts(SPACE + text.replace(" ", SPACE))
        parts += some
        counts.append(len(some))
    fresh = [p for p in dict.fromkeys(parts) if p not in lattices]
    if fresh:
        lattices.add(fresh)
    node = np.fromiter(map(lattices.__getitem__, parts), np.int64, len(parts))
    n = len(node)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    base = _mixed(np.repeat(np.array(keys, np.uint64), counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    shares, before = np.frombuffer(lattices.shares), np.frombuffer(lattices.before, np.int64)
    first, symbol = np.frombuffer(lattices.first, np.int64), np.frombuffer(lattices.symbol, np.int64)
    active = np.arange(n)
    steps = []
    step = 0
    while len(active):
        u = (_mixed(base[active] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53
        edge = first[node[active]]
        on = np.flatnonzero(u >= shares[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= shares[edge[on]]]
        steps.append((active, symbol[edge]))
        reached = before[edge]
        node[active] = reached
        active = active[reached >= 0]
        step += 1
    size = np.zeros(n, np.int64)
    for rows, _ in steps:
        size[rows] += 1
    end = np.cumsum(size)
    flat = np.empty(int(end[-1]) if n else 0, np.int64)
    for k, (rows, found) in enumerate(steps):
        flat[end[rows] - 1 - k] = found
    # Symbols of more than one id are rare: characters spelt in bytes.
    wide = np.ones(len(flat), np.int64)
    spelt = np.flatnonzero(flat >= len(lattices.pieces.bytes_of))
    some = [lattices.pieces.symbols[k] for k in flat[spelt].tolist()]
    wide[spelt] = [len(x) for x in some]
    stop = np.cumsum(wide)
    ids = np.repeat(flat, wide)
    if some:
        at = np.repeat(stop[spelt] - wide[spelt], wide[spelt])
        within = np.arange(len(at)) - np.repeat(np.cumsum(wide[spelt]) - wide[spelt], wide[spelt])
        ids[at + within] = np.concatenate(some)
    text_ends = np.concatenate([[0], end])[np.cumsum(counts)]
    return np.split(ids, np.concatenate([[0], stop])[text_ends][:-1])


def lattices_of(path: str, sharpness: float = SHARPNESS) -> Lattices:
    """The lattices of this worker."""
    return worker_table(("lattices", path, sharpness), lambda: Lattices(Pieces(path, sharpness)))


def _batches(batch: pa.RecordBatch):
    """Rows of a batch, about BATCH_CHARS characters at a time."""
    rows, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows.append(row)
        size += len(row[1])
        if size >= BATCH_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def encode_samples(docs: DataFrame, vocab: str, seed: int = SEED, sample: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id and the ids (little-endian unsigned 32 bit) of a sampled segmentation of every whole text.

    A null text is empty: its only piece is the word mark that stands before every text.
    Rows of one doc_id (also null) share a key, so repeated rows repeat their segmentation.
    """
    def rows(batch):
        lattices = lattices_of(vocab, sharpness)
        for some in _batches(batch):
            found = sampled(lattices, [t for _, t in some], [row_key(d, seed, sample) for d, _ in some])
            for (doc_id, _), ids in zip(some, found, strict=True):
                yield doc_id, ids.astype("<u4").tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    return doc_texts(docs).mapInArrow(arrow_rows(rows, schema, 200), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, vocab: str) -> DataFrame:
    """doc_id and text of encoded rows."""
    def rows(batch):
        pieces = lattices_of(vocab).pieces
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc_id, pieces.decode(np.frombuffer(ids, "<u4").tolist())

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return encoded.select("doc_id", "ids").mapInArrow(arrow_rows(rows, schema, 200), "doc_id long, text string")


def sampled_digests(docs: DataFrame, vocab: str, seed: int = SEED) -> DataFrame:
    """Per document: n_tokens, ids_crc32 and n_chars of the decoded text, with ``lossless``: decoding gave the text."""
    def rows(batch):
        lattices = lattices_of(vocab)
        for some in _batches(batch):
            found = sampled(lattices, [t for _, t in some], [row_key(d, seed) for d, _ in some])
            for (doc_id, text), ids in zip(some, found, strict=True):
                back = lattices.pieces.decode(ids.tolist())
                yield doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == text

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chars", pa.int64()), ("lossless", pa.bool_())])
    return doc_texts(docs).mapInArrow(arrow_rows(rows, schema), "doc_id long, n_tokens long, ids_crc32 long, n_chars long, lossless boolean")


def op4_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    return sampled_digests(documents(spark, sf_dir), vocabulary(PIECE_BPE))
