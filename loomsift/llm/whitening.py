"""Whitening of embeddings by an exact characteristic polynomial.

1. Components become integers.  Sums and products of the centred integers are added up in
   tasks, exactly; the scatter ``M = n * sum(x x') - S S'`` (``n`` squared times the
   covariance) is an integer matrix of ``dim`` squared numbers.
2. Its characteristic polynomial: modulo one prime after the other (a task each) the
   matrix is reduced to Hessenberg form, whose polynomial follows by a recurrence; Chinese
   remaindering gives the integer coefficients, as many primes as their bound asks for.
3. All roots are real, so Descartes' rule counts them exactly: the number of roots beyond
   ``t`` is the number of sign changes of the polynomial moved by ``t``.  Halving
   intervals isolates the roots, in integers, to ``BITS`` bits.
4. Components: inverse iteration on ``M - root`` in decimals of ``DIGITS`` digits, a task
   for each root; roots that do not part within ``BITS`` bits share a null space, in which
   the vectors are made orthogonal.
5. Rows are projected in tasks; the covariance of the whitened rows is checked over all.

What passes the driver is ``dim`` squared numbers and the roots, whatever the row count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BITS = 160
DIGITS = 90
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the polynomial --------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Exact below 3.3e24 (Miller-Rabin with the first thirteen primes)."""
    small = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41]
    if n < 43 or any(n % p == 0 for p in small):
        return n in small
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in small:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients (constant first) of the characteristic polynomial modulo a prime."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        times = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * times % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        factor, run = [int(h[k - 1, k - 1])], 1
        for i in range(1, k):
            run = run * int(h[k - i, k - i - 1]) % p
            factor.append(int(h[k - i - 1, k - 1]) * run % p)
        down = (np.array(factor)[:, None] * poly[k - 1::-1][:k] % p).sum(0)
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - down) % p
    return poly[d].tolist()


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of a positive semidefinite matrix's polynomial is larger (Maclaurin's inequality)."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return max((math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)), default=1)


def from_residues(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers nearest zero with these residues, by Chinese remaindering."""
    total, out = 1, [0] * len(residues[0][1])
    for p, values in residues:
        inverse = pow(total, -1, p)
        out = [x + total * ((v - x) * inverse % p) for x, v in zip(out, values, strict=True)]
        total *= p
    return [x - total if 2 * x > total else x for x in out]


# --- the roots -------------------------------------------------------------------

def _moved(coefficients: list[int], at: int, shift: int) -> list[int]:
    """The polynomial in ``y`` where its variable is ``(y + at) / 2**shift``, times a power of two."""
    d = len(coefficients) - 1
    out = [c << shift * (d - i) for i, c in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            out[j] += at * out[j + 1]
    return out


def roots_beyond(coefficients: list[int], at: int, shift: int) -> int:
    """How many roots, with multiplicity, exceed ``at / 2**shift``; all roots must be real."""
    signs = [c > 0 for c in _moved(coefficients, at, shift) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: int, shift: int) -> int:
    value = 0
    d = len(coefficients) - 1
    for i in range(d, -1, -1):
        value = value * at + (coefficients[i] << shift * (d - i))
    return (value > 0) - (value < 0)


def real_roots(coefficients: list[int], most: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """The ``most`` largest positive roots in falling order: (numerator, shift, multiplicity).

    The polynomial is monic with non-negative real roots only.  A root is
    ``numerator / 2**shift`` to ``bits`` bits; roots that do not part within them count as one.
    """
    zeros = next((i for i, c in enumerate(coefficients) if c), len(coefficients) - 1)
    poly = coefficients[zeros:]
    d = len(poly) - 1
    if not d:
        return []
    top = -poly[d - 1] + 1  # more than the sum of all roots
    todo = [(0, top, 0, d, 0)]
    out: list[tuple[int, int, int]] = []
    while todo and sum(m for _, _, m in out) < most:
        low, high, shift, beyond_low, beyond_high = todo.pop()
        many = beyond_low - beyond_high
        if not many:
            continue
        if many == 1:
            sign = _sign(poly, high, shift)
            while sign and high - low > low >> bits:
                if high - low == 1:
                    low, high, shift = 2 * low, 2 * high, shift + 1
                middle = (low + high) // 2
                if _sign(poly, middle, shift) in (0, sign):
                    high = middle
                else:
                    low = middle
            out.append((high, shift, 1))
        elif high - low <= low >> bits:
            out.append((high, shift, many))
        else:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            beyond = roots_beyond(poly, middle, shift)
            todo.append((low, middle, shift, beyond_low, beyond))
            todo.append((middle, high, shift, beyond, beyond_high))
    return out


# --- the components --------------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: tuple[int, int, int], digits: int = DIGITS) -> list[list[float]]:
    """Orthonormal vectors that ``matrix - root`` sends to zero, by inverse iteration in decimals."""
    numerator, shift, many = root
    with localcontext() as context:
        context.prec = digits
        value = Decimal(numerator) / (1 << shift)
        d = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= value
        # A pivot of exactly zero (a root met exactly) gets the size of the last digit.
        tiny = max(abs(value), Decimal(1)).scaleb(-digits)
        swaps = []
        for k in range(d):
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            swaps.append(pivot)
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= a[k + 1:, k, None] * a[k, k + 1:]
        found: list[np.ndarray] = []
        rng = np.random.default_rng(1)
        for _ in range(many):
            x = np.array([Decimal(float(v)) for v in rng.normal(size=d)], object)
            for _ in range(4):
                for k, pivot in enumerate(swaps):
                    x[k], x[pivot] = x[pivot], x[k]
                for k in range(d):
                    x[k + 1:] -= a[k + 1:, k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] = x[k] / a[k, k]
                    x[:k] -= a[:k, k] * x[k]
                for other in [*found, *found]:
                    x = x - other * (other * x).sum()
                x = x / (x * x).sum().sqrt()
            found.append(x)
        return [[float(v) for v in x] for x in found]


# --- the job ---------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, key: str, column: str, scale: int, offset: int) -> DataFrame:
    """vec_id and the integer vector x of every row whose vector is whole and finite."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.when(F.abs(c * scale) < 9e18, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component does not fit a long")).cast("long")) + offset)
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
            .where(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0)).select("vec_id", whole.alias("x")))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of integers as Python integers."""
    top = int(np.abs(x).max(initial=0)) ** 2 * max(1, len(x))
    if top < 1 << 53:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    return (x.T @ x if top < 1 << 63 else x.astype(object).T @ x.astype(object)).astype(object)


def _pairs_summed(rows: DataFrame, gram, kind: str, arrow: pa.DataType, dim: int) -> np.ndarray:
    """Sum over all rows of a task-wise symmetric matrix; what leaves a task is half of that matrix."""
    i, j = np.triu_indices(dim)

    def task(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = gram(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].tolist(), arrow)], names=["i", "j", "v"])

    out = np.zeros((dim, dim), object)
    for r in rows.mapInArrow(task, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def scatter(rows: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """``n`` squared times the covariance of the integer vectors, exactly."""
    dim = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    total = _pairs_summed(rows.select("x"), lambda batch: np.vectorize(_decimal, otypes=[object])(exact_gram(_matrix(batch.column(0), dim) - centre)),
                          "decimal(38,0)", pa.decimal128(38, 0), dim)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    return [[n * int(total[i, j]) - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]


def _decimal(v: int) -> Decimal:
    return Decimal(int(v))


def principal_components(spark, matrix: list[list[int]], most: int) -> list[tuple[int, int, list[float]]]:
    """Root (numerator, shift) and unit vector of the ``most`` largest positive eigenvalues, falling."""
    held = spark.sparkContext.broadcast(matrix)
    primes = primes_beyond(2 * coefficient_bound(matrix) + 1)

    def residues(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([p]), pa.array([polynomial_mod(held.value, p)])], names=["p", "c"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    by_prime = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p").mapInArrow(residues, "p long, c array<long>").collect()
    roots = real_roots(from_residues([(r.p, r.c) for r in by_prime]), most)
    if not roots:
        return []

    def vectors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at, numerator, shift, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = null_vectors(held.value, (int(numerator), shift, many))
                yield pa.record_batch([pa.array([at] * many), pa.array(found)], names=["at", "v"])

    rows = [(at, str(numerator), shift, many) for at, (numerator, shift, many) in enumerate(roots)]
    by_root = (spark.createDataFrame(rows, "at long, numerator string, shift int, many int").repartition(len(roots), "at")
               .mapInArrow(vectors, "at long, v array<double>").collect())
    parts = sorted(by_root, key=lambda r: r.at)
    return [(roots[r.at][0], roots[r.at][1], list(r.v)) for r in parts][:most]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """Projections of every vector on the principal components, scaled to unit variance.

    vec_id, component (from 1, by falling eigenvalue), n, deviation (sum over the
    dimensions of ``(n * x - S)**2``), whitened, explained (share of the trace) and
    identity_error (the same on every row).  The fit list is every row that is returned;
    a component ``c`` counts as ``x = floor(scale * c) + offset``.

    Left out: null or empty vectors and those with null or non-finite entries, and where
    lengths differ all but the most frequent one (ties: the longest).  Repeated rows count
    each; a null vec_id stays null.  Components of eigenvalue zero are left out, so equal
    rows, one row or an empty table give no rows.  Numbers beyond a long fail the job.
    """
    spark = vectors.sparkSession
    every = written(integer_vectors(vectors, key, column, scale, offset), "integer-vectors")
    empty = spark.createDataFrame([], OUT)
    length = every.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).first()
    if length is None:
        return empty
    dim, n = length.dim, length.n
    rows = every.where(F.size("x") == dim)
    summed = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r.s) for r in sorted(summed, key=lambda r: r.i)]
    matrix = scatter(rows, n, sums)
    trace = sum(matrix[i][i] for i in range(dim))
    found = principal_components(spark, matrix, components) if trace else []
    if not found:
        return empty
    shares = [float(Decimal(numerator) / (1 << shift) / trace) for numerator, shift, _ in found]
    # e is the eigenvalue over n squared.
    axes = np.array([v for _, _, v in found])
    axes /= np.array([math.sqrt(Decimal(numerator) / (1 << shift) / (n * n)) for numerator, shift, _ in found])[:, None]
    most = len(axes)
    wide = n * max(map(abs, sums)) >= 1 << 62

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(batch.num_columns - 1), dim)
        return (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)

    def projected(y: np.ndarray) -> np.ndarray:
        return (y / n).astype(np.float64) @ axes.T

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        w = np.column_stack([projected(centred(batch)), np.ones(batch.num_rows)])
        return w.T @ w

    total = _pairs_summed(rows.select("x"), gram, "double", pa.float64(), most + 1).astype(np.float64)
    mean = total[:most, most] / n
    error = float(np.abs(total[:most, :most] / n - np.outer(mean, mean) - np.eye(most)).max())

    def project(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            y = centred(batch)
            narrow = not wide and int(np.abs(y).max(initial=0)) ** 2 * dim < 1 << 63
            far = (y * y if narrow else y.astype(object) ** 2).sum(1).tolist()
            w = projected(y)
            many = batch.num_rows * most
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), most))), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(many, n)), pa.array([v for v in far for _ in range(most)], pa.int64()), pa.array(w.ravel()),
                pa.array(np.tile(shares, batch.num_rows)), pa.array(np.full(many, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
