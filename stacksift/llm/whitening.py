"""Whitening of embeddings by shifted Cholesky QR: distributed Gram passes, triangular solves, one small SVD."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.llm.common import materialize, partitions, renamed, tidy, with_field

#: Rows that a task works on at a time.
ROWS = 4096
#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Sums below this are worked out in 64 bits, larger ones in Python's integers.
SAFE = 1 << 62


def whole_vectors(df: DataFrame, vector: str, x: str = "x") -> DataFrame:
    """Rows whose vector can be used, with the whole numbers x = floor(256 * entry).

    Rows go if their vector is null or holds a null or an entry that is not finite, and if its length is not
    the commonest one (of equally common ones the longest, never 0): they have no place in the space. Entries
    beyond the range of a long count as its ends.
    """
    df = renamed(df, x)
    entries = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(entries, lambda c: F.coalesce((c > -math.inf) & (c < math.inf), F.lit(False)))  # NaN is above infinity
    kept = df.where(F.col(f"`{vector}`").isNotNull() & sound & (F.size(f"`{vector}`") > 0))
    common = kept.groupBy(F.size(f"`{vector}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    kept = kept.where(F.size(f"`{vector}`") == (common["d"] if common else 0))
    return kept.withColumn(x, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")))


def row_blocks(batch: pa.RecordBatch, x: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for k in range(0, batch.num_rows, ROWS):
        b = batch.slice(k, ROWS)
        yield b, b.column(x).flatten().to_numpy().reshape(b.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: the numerators n * x - S are whole numbers."""
    return numerators(x, n, sums).astype(np.float64) / n


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null where a long cannot hold it."""
    d = numerators(x, n, sums)
    if d.dtype == object or len(d) and d.shape[1] * int(np.abs(d).max()) ** 2 >= SAFE:
        found = [sum(int(v) * int(v) for v in row) for row in d]
        return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())
    return pa.array((d * d).sum(axis=1), pa.int64())


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(rows: DataFrame, x: str, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of outer products of `of`(block) over all rows: one matrix per task, then one per group of tasks.

    About the square root of the number of tasks comes to the driver, width x width numbers each.
    """
    schema = T.StructType([T.StructField("g", T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for whole in batches:
            for _, block in row_blocks(whole, x):
                q = of(block)
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for whole in batches:
            for g in whole.column("g"):
                total += np.frombuffer(g.as_py()).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts = rows.select(x).mapInArrow(tidy(partial), schema)
    groups = max(1, math.isqrt(partitions(rows.sparkSession)))
    found = parts.repartition(groups).mapInArrow(tidy(added), schema).collect()
    return sum((np.frombuffer(r["g"]).reshape(width, width) for r in found), np.zeros((width, width)))


def shifted_cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of g + shift, the shift raised until the factorisation succeeds."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * max(np.trace(g), np.finfo(float).tiny))


@dataclass
class Whitening:
    """What a fit gives: a few numbers per dimension, of a size that does not follow the rows."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x kept, unit columns
    eigenvalues: np.ndarray  # of all directions, falling
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        kept = self.components.shape[1]
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(np.maximum(self.eigenvalues[:kept], np.finfo(float).tiny))

    def explained(self) -> np.ndarray:
        return self.eigenvalues[: self.components.shape[1]] / max(self.eigenvalues.sum(), np.finfo(float).tiny)


def fit(rows: DataFrame, x: str = "x", components: int = 4, passes: int = 3, tolerance: float = 1e-4) -> Whitening | None:
    """The leading components of the distinct vectors of whole numbers in rows; None if there are none.

    The centred rows X are orthogonalised by Gram passes: G = Q'Q with Q = X R1^-1 .. Ri^-1 (triangular solves in
    the tasks), G + shift = R'R. The first shift keeps the factor of an ill-conditioned G positive, the later
    passes mend what it left. With R = Rk .. R1, X = Q R, so the right singular vectors of the small R are the
    eigenvectors of X'X, and its squared singular values over n the eigenvalues, to double precision, as G itself
    is never taken apart. The eigenvalue found for a direction without variance is rounding: a last pass measures
    the variance of the whitened components, and those where it is not 1 are not returned.

    The distinct vectors are written as a table once; each pass reads it. Dimensions must fit a task: memory is a
    few d x d matrices and blocks of 4,096 rows.
    """
    own = materialize(rows.select(x).distinct(), "fit_list")
    at = own.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(at.collect())  # one row per dimension
    if not found:
        return None
    n, sums, width = found[0]["n"], [int(r["s"]) for r in found], len(found)
    factors: list[np.ndarray] = []

    def orthogonal(block: np.ndarray) -> np.ndarray:
        q = centred(block, n, sums)
        for upper in factors:
            q = solved(q, upper)
        return q

    for k in range(passes):
        g = gram(own, x, orthogonal, width)
        if not g.any():  # all vectors are equal
            return Whitening(n, sums, np.zeros((width, 0)), np.zeros(width))
        eps = np.finfo(float).eps / 2
        scale = np.linalg.norm(g, 2)
        factors.append(shifted_cholesky(g, 11 * (n * width + width * (width + 1)) * eps * scale if k == 0 else 0.0))
    r = np.eye(width)
    for upper in factors:
        r = upper @ r
    _, sigma, right = np.linalg.svd(r)
    eigenvalues = sigma**2 / n
    some = min(components, width)
    off = np.abs(gram(own, x, Whitening(n, sums, right[:some].T, eigenvalues).whitened, some) / n - np.eye(some))
    kept = int(np.cumprod(np.diag(off) <= tolerance).sum())
    return Whitening(n, sums, right[:kept].T.copy(), eigenvalues, float(off[:kept, :kept].max(initial=0.0)))


def transform(rows: DataFrame, model: Whitening, x: str = "x") -> DataFrame:
    """rows with deviation (exact; null beyond a long) and whitened, an array of one number per component."""
    rows = renamed(rows, "deviation", "whitened")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, block in row_blocks(whole, x):
                w = model.whitened(block)
                edges = pa.array(np.arange(len(block) + 1) * w.shape[1], pa.int32())
                columns = [deviations(block, model.n, model.sums), pa.ListArray.from_arrays(edges, pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "deviation", "whitened"])

    schema = with_field(rows, "deviation", T.LongType()).add("whitened", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(tidy(run), schema)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Rows and vectors: see whole_vectors; fit: see fit. Repeated rows each have their own result and count once in
    the fit. Null keys stay. Equal vectors only, a single one, or none: no component, so an empty result. Extra
    columns of df are ignored. identity_error is the fit list's, one value.
    """
    rows = whole_vectors(df.select(key, vector), vector)
    spark = df.sparkSession
    result = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [T.StructField(c, k) for c, k in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]
    )
    model = fit(rows, components=components)
    if model is None or not model.components.shape[1]:
        return spark.createDataFrame([], result)
    explained = F.array(*[F.lit(float(v)) for v in model.explained()])
    found = transform(rows.select(key, "x"), model).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
