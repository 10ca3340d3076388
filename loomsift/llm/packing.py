"""Best-fit packing by linear grouping.

1. Every document becomes ids plus an end id; only documents longer than a sequence are
   cut.  A piece is a length; the whole plan depends on the counts of the at most
   ``size`` lengths, which is all that reaches the driver.
2. Linear grouping: pieces longer than a part of ``size`` are ranked by length and cut into
   groups of equal cardinality; each counts as the longest of its group.
3. The few sizes are packed by configurations: a linear programme solved by column
   generation, rounded down.
4. Actual pieces take the places: piece number r of a group is in a sequence given by
   arithmetic on r.  What the rounding wasted is free space again.
5. Pieces left over and small ones, longest first, go to the sequence with the least
   sufficient space.  Sequences of equal space are alike, so this is a walk over
   (space, interval of sequences), bounded by the sequence size and not by the data.

The plan is a list of runs: (length, interval of piece numbers of that length) to first
sequence, pieces in each sequence and offset.  Pieces are numbered within (length,
lane), and a lane's first number is a running sum of counts.  Lanes are dealt in turn when
the pieces are written, so a length, document or repeated row that makes up a third of
all pieces is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.common import arrow_rows, doc_texts, documents, vocabulary, written
from loomsift.llm.tokens import WORD_BPE, bpe_words

SEQUENCE = 2048
#: Numbers of groups that are tried, each with every cutoff; the first plan with the fewest sequences is kept.
GROUPS = (16, 8, 4, 3)
#: Pieces longer than this part of a sequence are grouped.
SMALL_PARTS = (4, 3, 2)
BUCKETS = 1024


# --- the plan ------------------------------------------------------------------

def configurations(sizes: list[int], demand: list[int], space: int) -> list[tuple[list[int], float]]:
    """Fractional number of sequences for each configuration (items of each size).

    The covering programme of cutting stock: start with one size in a sequence, price
    new columns by a knapsack over the space, stop when none helps.
    """
    k = len(sizes)
    basis = np.diag([space // s for s in sizes]).astype(float)
    want = np.array(demand, float)
    for _ in range(40 * k):
        x = np.linalg.solve(basis, want)
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(space + 1)
        pick = np.full(space + 1, -1)
        # Unbounded knapsack: one pass over the space, sizes side by side.
        order = np.array(sizes)
        for c in range(1, space + 1):
            best[c], pick[c] = best[c - 1], -1
            fits = order <= c
            if fits.any():
                value = np.where(fits, price + best[np.maximum(c - order, 0)], -1)
                j = int(value.argmax())
                if value[j] > best[c] + 1e-12:
                    best[c], pick[c] = value[j], j
        if best[space] <= 1 + 1e-9:
            break
        column = np.zeros(k)
        c = space
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, want)
    return [([int(round(v)) for v in basis[:, i]], float(x[i])) for i in range(k) if x[i] > 1e-9]


@dataclass
class Plan:
    """Runs of pieces of one length: first number, end, sequence, pieces in each, offset."""

    space: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    groups: int = 0
    small_part: int = 0

    def table(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


def plan_packing(counts: dict[int, int], space: int = SEQUENCE, groups: Sequence[int] = GROUPS) -> Plan:
    """Where the pieces of each length go, from the number of pieces of each length."""
    return min((_plan(counts, space, g, part) for part in SMALL_PARTS for g in groups), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], space: int, groups: int, small_part: int) -> Plan:
    plan = Plan(space, groups=groups, small_part=small_part)
    full = counts.get(space, 0)
    if full:
        plan.runs.append((space, 0, full, 0, 1, 0))
        plan.sequences = full
    least = space // small_part
    large = sorted((x for x, n in counts.items() if least < x < space and n), reverse=True)
    free: dict[int, list[tuple[int, int]]] = {}
    left: dict[int, list[tuple[int, int]]] = {x: [(0, n)] for x, n in counts.items() if x <= least and x < space and n}
    if large:
        for x, intervals in _place_large(plan, large, counts, groups, free).items():
            left.setdefault(x, []).extend(intervals)
    _best_fit(plan, left, free)
    return plan


def _place_large(plan: Plan, large: list[int], counts: dict[int, int], groups: int, free: dict) -> dict:
    ends = np.cumsum([counts[x] for x in large])
    starts = ends - [counts[x] for x in large]
    total = int(ends[-1])

    def length_at(rank: int) -> tuple[int, int]:
        i = int(np.searchsorted(ends, rank, "right"))
        return large[i], rank - int(starts[i])

    cuts = sorted({round(total * g / groups) for g in range(groups + 1)})
    bounds: list[list[int]] = []  # first rank, end, rounded-up size
    for a, b in zip(cuts, cuts[1:]):
        size = length_at(a)[0]
        if bounds and bounds[-1][2] == size:
            bounds[-1][1] = b
        else:
            bounds.append([a, b, size])
    used = [a for a, _, _ in bounds]
    for column, times in configurations([s for _, _, s in bounds], [b - a for a, b, _ in bounds], plan.space):
        n = int(times + 1e-6)
        n = min([n, *((bounds[g][1] - used[g]) // k for g, k in enumerate(column) if k)])
        if n <= 0:
            continue
        parts = [(g, k, used[g]) for g, k in enumerate(column) if k]
        # Sequences between two breakpoints hold equal lengths.
        breaks = {0, n}
        for _, k, r0 in parts:
            inside = ends[(ends > r0) & (ends < r0 + n * k)]
            for e in inside.tolist():
                j = (e - r0) // k
                breaks |= {j, min(n, j + 1)}
        points = sorted(breaks)
        for j0, j1 in zip(points, points[1:]):
            at = 0
            for _, k, r0 in parts:
                lengths = [length_at(r0 + j0 * k + t) for t in range(k)]
                if lengths[0][0] == lengths[-1][0]:
                    x, i = lengths[0]
                    plan.runs.append((x, i, i + (j1 - j0) * k, plan.sequences + j0, k, at))
                    at += k * x
                else:  # a change of length inside a sequence: that sequence stands alone
                    for x, i in lengths:
                        plan.runs.append((x, i, i + 1, plan.sequences + j0, 1, at))
                        at += x
            free.setdefault(plan.space - at, []).append((plan.sequences + j0, j1 - j0))
        plan.sequences += n
        for g, k, _ in parts:
            used[g] += n * k
    left: dict[int, list[tuple[int, int]]] = {}
    for g, (_, b, _) in enumerate(bounds):
        rank = used[g]
        while rank < b:
            i = int(np.searchsorted(ends, rank, "right"))
            stop = min(b, int(ends[i]))
            left.setdefault(large[i], []).append((rank - int(starts[i]), stop - int(starts[i])))
            rank = stop
    return left


def _best_fit(plan: Plan, left: dict[int, list[tuple[int, int]]], free: dict[int, list[tuple[int, int]]]) -> None:
    """Longest first into the least sufficient space; new sequences where none suffices."""
    free.pop(0, None)
    spaces = sorted(free)

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                spaces.insert(bisect_left(spaces, space), space)
                free[space] = []
            free[space].append((first, n))

    for x in sorted(left, reverse=True):
        for first, end in left[x]:
            while first < end:
                at = bisect_left(spaces, x)
                if at < len(spaces):
                    space = spaces[at]
                    sequence, n = free[space].pop()
                    if not free[space]:
                        del free[space]
                        spaces.pop(at)
                else:
                    space = plan.space
                    sequence, n = plan.sequences, -(-(end - first) // (space // x))
                    plan.sequences += n
                per = space // x
                many = min(n, (end - first) // per)
                offset = plan.space - space
                if many:
                    plan.runs.append((x, first, first + many * per, sequence, per, offset))
                    first += many * per
                    put(space - per * x, sequence, many)
                if many < n:
                    rest = end - first if end - first < per else 0
                    if rest:
                        plan.runs.append((x, first, end, sequence + many, rest, offset))
                        first = end
                        put(space - rest * x, sequence + many, 1)
                        put(space, sequence + many + 1, n - many - 1)
                    else:
                        put(space, sequence + many, n - many)


# --- the job -------------------------------------------------------------------

def document_pieces(docs: DataFrame, vocab: str, size: int = SEQUENCE, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32[, ids binary]."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * keep_ids

    def rows(batch):
        words = bpe_words(vocab)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(words.encode(text), np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), size)):
                data = ids[start:start + size].tobytes()
                row = doc_id, piece, start, len(data) // 4, zlib.crc32(data)
                yield (*row, data) if keep_ids else row

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return doc_texts(docs).mapInArrow(arrow_rows(rows, pa.schema(fields), 500 if keep_ids else 2000), kinds)


def numbered(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``idx``, the piece's number among those of its length, in place of ``lane``."""
    dealt = pieces.withColumn("bucket", F.pmod("lane", F.lit(buckets)).cast("int")).drop("lane")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (dealt.withColumn("idx", F.row_number().over(order) - 1).join(firsts, ["length", "bucket"])
            .withColumn("idx", F.col("first") + F.col("idx")).drop("first", "bucket"))


def stored(pieces: DataFrame) -> DataFrame:
    """The pieces written with a ``lane``, a number that runs on in each task; fixed from then on."""
    return written(pieces.withColumn("lane", F.monotonically_increasing_id()), "pieces")


def pack(pieces: DataFrame, size: int = SEQUENCE, groups: Sequence[int] = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length at most ``size``), which have a ``lane`` (see ``stored``)."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, size, groups)
    table = pieces.sparkSession.sparkContext.broadcast(plan.table())
    names = [n for n in pieces.columns if n != "lane"]
    schema = f"{', '.join(f'`{n}` {t}' for n, t in pieces.select(*names).dtypes)}, sequence_id long, offset long"

    def place(batches):
        runs = table.value
        key = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            idx = batch.column(len(names)).to_numpy()
            run = runs[np.searchsorted(key, length << 48 | idx, "right") - 1]
            inside = idx - run[:, 1]
            columns = [*batch.columns[:-1], pa.array(run[:, 3] + inside // run[:, 4]), pa.array(run[:, 5] + inside % run[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return numbered(pieces).select(*names, "idx").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocab: str, size: int = SEQUENCE, end_id: int = 0, groups: Sequence[int] = GROUPS,
                   keep_ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``size`` ids.

    One row per piece.  A null text is empty: one piece holding the end id.  Null
    doc_ids and repeated rows are packed like any others; an empty table gives no rows.
    ``keep_ids`` carries the ids for ``sequences``.
    """
    return pack(stored(document_pieces(docs, vocab, size, end_id, keep_ids)), size, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length and the ids (little-endian unsigned 32 bit) side by side."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "n_pieces", "length", F.aggregate(
                "parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary(WORD_BPE))
