"""Embedding whitening: principal components from an exact characteristic polynomial.

Vectors become integers, so their scatter matrix is an integer matrix, summed without rounding. Its
characteristic polynomial is computed modulo many primes (one Hessenberg reduction each, dealt over
tasks) and put together by the Chinese remainder theorem. Its roots, all real, are isolated by
counting sign changes and refined by halving; eigenvectors follow by inverse iteration on the null
space in long decimals. Only matrices of the dimension's size pass through the driver.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from decimal import Decimal
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import stored
from mediaops.llm.topk import clean

#: Rows of one product of small matrices.
ROWS = 4096
#: Roots closer than this share of their size count as one of higher multiplicity.
SAME = 100
#: Bits to which a single root is refined, and digits of the inverse iteration.
BITS, DIGITS = 160, 90


def usual_length(vectors: DataFrame) -> int:
    """The commonest length of ``v``, the longest of equally common ones; 0 without vectors."""
    top = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y^T y as Python integers: by floating point where every partial sum fits its 53 bits."""
    out = np.zeros((y.shape[1],) * 2, object)
    most = max(abs(int(y.max())), abs(int(y.min())), 1) if y.size else 1
    rows = min(ROWS, (1 << 53) // (most * most))
    if not rows:
        wide = y.astype(object)
        return wide.T @ wide
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], list], kind: str) -> list:
    """The sums of the lists that ``work`` makes of each partition, by position: [(sum, largest)]."""
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = work(batches)
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, arrow)], ["pos", "value"])

    rows = df.mapInArrow(run, f"pos int, value {kind}").groupBy("pos").agg(F.sum("value").alias("s"), F.max("value").alias("m"))
    return [(r.s, r.m) for r in sorted(rows.collect(), key=lambda r: r.pos)]


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray, int]:
    """Of an integer column ``v`` of length ``d``: rows n, sums S, the matrix n * sum of v v^T - S S^T
    in whole numbers, and a bound of all absolute entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> list:
        n, most, s, gram = 0, 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = matrix(batch.column(0), d)
            if len(y):
                n, most = n + len(y), max(most, abs(int(y.max())), abs(int(y.min())))
                s += y.sum(0, dtype=np.int64).astype(object) if most < 1 << 40 else y.astype(object).sum(0)
                gram += exact_gram(y)
        return [Decimal(int(x)) for x in [n, most, *s, *gram[np.triu_indices(d)]]] if n else []

    found = summed(vectors.select("v"), work, "decimal(38,0)")
    if not found:
        return 0, [], np.zeros((0, 0), object), 0
    n, most, values = int(found[0][0]), int(found[1][1]), [int(s) for s, _ in found[2:]]
    gram, at = np.zeros((d, d), object), np.triu_indices(d)
    gram[at] = values[d:]
    gram.T[at] = values[d:]
    s = np.array(values[:d], object)
    return n, values[:d], n * gram - np.outer(s, s), most


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide all numbers below 3,215,031,751."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    r = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, (n - 1) >> r, n)
        if x != 1 and not any(pow(x, 1 << j, n) == n - 1 for j in range(r)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31 whose product is larger than ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - m) modulo the prime ``p``: similar row and column steps
    bring m to Hessenberg form, whose leading minors follow from one another."""
    d = len(m)
    h = (m % p).astype(np.int64)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), p - 2, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        factors, step = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # minor i meets entry (i, k-1) and the subdiagonal between them
            factors[i] = step * int(h[i, k - 1]) % p
            step = step * int(h[i, i - 1]) % p if i else 0
        minors[k] = (minors[k] - (factors[:, None] * minors[:k] % p).sum(0)) % p
    return minors[d]


def characteristic_polynomial(spark, m: np.ndarray) -> list[int]:
    """The integer coefficients, lowest first, of det(x - m) for a symmetric matrix ``m`` of integers
    with no negative eigenvalue (their k-th symmetric sum is at most that of equal ones)."""
    d, trace = len(m), int(np.trace(m))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    sent = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(0).to_pylist()
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array([polynomial_modulo(sent.value, p).tolist() for p in got], pa.list_(pa.int64()))], ["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    rows = dealt.mapInArrow(run, "p long, c array<long>").collect()
    product = 1
    for r in rows:
        product *= r.p
    parts = [(r.c, product // r.p * pow(product // r.p, -1, r.p)) for r in rows]
    out = [sum(c[k] * e for c, e in parts) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in out]


def larger(q: list[int], at: int, t: int) -> int:
    """How many roots of ``q`` exceed at / 2^t, all roots being real: the sign changes of q(x + at / 2^t)."""
    r = len(q) - 1
    b = [c << t * (r - k) for k, c in enumerate(q)]
    for k in range(r):
        for j in range(r - 1, k - 1, -1):
            b[j] += at * b[j + 1]
    signs = [c > 0 for c in b if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value(q: list[int], at: int, t: int) -> int:
    """The sign-bearing q(at / 2^t) * 2^(t deg q)."""
    out, r = 0, len(q) - 1
    for k in range(r, -1, -1):
        out = out * at + (q[k] << t * (r - k))
    return out


def largest_roots(q: list[int], k: int) -> list[tuple[Decimal, int]]:
    """The largest ``k`` positive roots (and those that share the last one's place), falling, as
    (root, multiplicity), of a polynomial whose roots are all real and positive."""
    out: list[tuple[Decimal, int]] = []
    top = 1 << max(sum(abs(c) for c in q[-2:-1]).bit_length(), 1)  # the sum of all roots
    todo, have = [(0, top, 0, len(q) - 1, 0)], 0  # roots in (low, high] / 2^t; those above low, above high
    while todo and have < k:
        low, high, t, above, beyond = todo.pop()
        if above == beyond:
            continue
        narrow = (high - low) << SAME <= high
        if above - beyond > 1 and not narrow:
            mid = low + high
            low, high, t = 2 * low, 2 * high, t + 1
            between = larger(q, mid, t)
            todo += [(low, mid, t, above, between), (mid, high, t, between, beyond)]
            continue
        while above - beyond == 1 and (high - low) << BITS > high:
            mid, low, high, t = low + high, 2 * low, 2 * high, t + 1
            v = value(q, mid, t)
            if v == 0:
                low = high = mid
            elif (v > 0) == (beyond % 2 == 0):  # as many roots above mid as above high
                high = mid
            else:
                low = mid
        out.append((Decimal(low + high) / (Decimal(2) ** (t + 1)), above - beyond))
        have += above - beyond
    return out


def null_vectors(m: np.ndarray, root: Decimal, many: int) -> list[np.ndarray]:
    """``many`` orthonormal vectors of decimals that m - root brings closest to zero."""
    d = len(m)
    lu = np.array([[Decimal(int(x)) for x in row] for row in m], object)
    lu[np.arange(d), np.arange(d)] -= root
    order, tiny = list(range(d)), Decimal(10) ** -DIGITS * max(root, Decimal(1))
    for k in range(d):
        i = max(range(k, d), key=lambda i: abs(lu[i, k]))
        lu[[i, k]], order[i], order[k] = lu[[k, i]], order[k], order[i]
        if abs(lu[k, k]) < tiny:
            lu[k, k] = tiny
        lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
        lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
    draw = np.random.default_rng(0).integers(1, 1000, (many, d))
    out = [np.array([Decimal(int(x)) for x in row], object) for row in draw]
    for _ in range(3):
        done: list[np.ndarray] = []
        for v in out:
            x = v[order]
            for k in range(d):
                x[k + 1 :] -= lu[k + 1 :, k] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] /= lu[k, k]
                x[:k] -= lu[:k, k] * x[k]
            x = x / max(abs(x))
            for w in done * 2:
                x = x - w * (w @ x)
            done.append(x / (x @ x).sqrt())
        out = done
    return out


def principal_components(spark, m: np.ndarray, k: int) -> list[tuple[Decimal, np.ndarray]]:
    """The ``k`` largest positive eigenvalues of the integer matrix with their unit vectors; fewer where
    the rank is smaller. Vectors of equal eigenvalues are an orthonormal choice."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        q = characteristic_polynomial(spark, m)
        while len(q) > 1 and q[0] == 0:
            q = q[1:]
        found = [(root, v) for root, many in largest_roots(q, k) for v in null_vectors(m, root, many)] if len(q) > 1 else []
    return found[:k]


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Whitened coordinates of the integer vectors ``v`` (array<long>, no nulls) of each ``vec_id``.

    One row per vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation
    (decimal: sum of (n v - S)^2, exact), whitened, explained, identity_error (measured on the
    whitened values themselves). Vectors of another length than the commonest take no part. Repeated
    rows count and are returned each; a null vec_id stays null. Only components with a positive
    eigenvalue exist: a table of equal vectors, or an empty one, gives no rows.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.select("vec_id", "v"), "integer-vectors")
    d = usual_length(vectors)
    vectors = vectors.filter(F.size("v") == d)
    n, s, m, most = scatter(vectors, d) if d else (0, [], np.zeros((0, 0), object), 0)
    found = principal_components(spark, m, components) if n else []
    if not found:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    # V = m / n^2; x - S/n = (n v - S) / n, so its projection over sqrt(e) is (n v - S) . u / sqrt(eigenvalue of m)
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        axes = np.array([[float(x / root.sqrt()) for x in v] for root, v in found])
        explained = [float(root / int(np.trace(m))) for root, _ in found]
    small = d * (2 * n * max(most, 1)) ** 2 < 1 << 63
    sums = np.array(s, np.int64 if small else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch.column(1), d)
            away = y * n - sums if small else y.astype(object) * n - sums
            squares = [Decimal(int(x)) for x in (away * away).sum(1)]
            w = away.astype(float) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    wide = stored(vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    k = len(found)

    def total(center: np.ndarray | None):
        def work(batches: Iterator[pa.RecordBatch]) -> list:
            out = np.zeros(k if center is None else k * k)
            for batch in batches:
                w = batch.column(0).flatten().to_numpy().reshape(-1, k)
                out += w.sum(0) if center is None else ((w - center).T @ (w - center)).ravel()
            return out.tolist()

        return np.array([x for x, _ in summed(wide.select("w"), work, "double")]) / n

    error = float(abs(total(total(None)).reshape(k, k) - np.eye(k)).max())
    rows = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)), F.col("at"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """whiten on all embeddings, up to 8 components. Null vectors and those with null or non-finite
    entries are left out; so are empty ones. Entries whose scaled value does not fit a long, and
    deviations that do not, raise an error."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(clean(F.col("embedding")))
    # adding 100000 to every entry moves the sums but none of the results: covariances and deviations are centred
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024)).alias("v"))
    return whiten(rows).withColumn("deviation", F.col("deviation").cast("long"))
