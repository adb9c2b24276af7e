"""Embedding whitening over distinct vectors, each with its multiplicity as a weight.

Every component c becomes the integer floor(scale * c) + offset. Rows with equal integer vectors are grouped
first; the fit runs over the distinct vectors, each weighted by its count or by one. Sums and the centred
weighted product ``sum(w * z' z)`` are added up by task, so only numbers of the order of dimension squared reach the
driver, which finds the eigenvectors. Each distinct vector is whitened once and joined back to its rows.

The join stays even under a hot vector: rows are dealt over 63 slices by the hash of ``vec_id``, a distinct
vector carries the bits of the slices its rows lie in, and one copy goes to each of them. Vectors are joined by two
64-bit hashes. Sums are of integers and exact; ``z`` is the exact ``n * x - S`` divided by ``n``, so the offset costs no digits.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does
one whose length is not the commonest (ties: the longer); a null ``vec_id`` is kept; repeated rows repeat in the result
and count as one distinct vector; components without variance (fewer distinct vectors than dimensions) have a null
``whitened`` and are left out of ``identity_error``; ``deviation`` is null where it passes a long; an empty table gives no
rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
SLICES = 63
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
WHITENED = pa.schema([
    ("k1", pa.int64()), ("k2", pa.int64()), ("w", pa.int64()), ("slices", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def exact(largest: float) -> bool:
    """Whether numbers up to ``largest`` can be computed in 64-bit integers."""
    return largest < 2**62


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, in Python integers where 64 bits are too few."""
    top = max(float(np.abs(x.astype(float)).max(initial=0)) * n, *(abs(s) for s in sums))
    if exact(2.0 * top):
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(far: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    if far.dtype != object and exact(float(np.abs(far).max(initial=0)) ** 2 * far.shape[1]):
        return (far * far).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in ((far.astype(object) ** 2).sum(axis=1)).tolist()]


def sums(df: DataFrame, column: str, weight: str, kind: type = int) -> tuple[int, list]:
    """``(sum of weights, weighted sum of each component)`` over all rows; integers are added exactly."""
    value = "decimal(38,0)" if kind is int else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = 0, None
        for got in batches:
            x, w = matrix(got.column(0)), got.column(1).to_numpy()
            if kind is int and not exact(float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())):
                x, w = x.astype(object), w.astype(object)
            part = (x * w[:, None]).sum(axis=0)
            at = part.astype(object if kind is int else float) + (0 if at is None else at)
            total += int(w.sum())
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(at))], pa.int32()), pa.array([str(v) for v in [total, *at]])], names=["i", "v"])

    found = df.select(column, weight).mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast(value)).alias("v")).collect()
    by = {r["i"]: r["v"] for r in found}
    return int(by.pop(-1, 0)), [kind(by[i]) for i in sorted(by)]


def centred_product(df: DataFrame, column: str, weight: str, n: int, total: list) -> np.ndarray:
    """``sum(w * z' z)`` for ``z = x - S / n``, one partial product for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for got in batches:
            x, w = matrix(got.column(0)), got.column(1).to_numpy().astype(float)
            z = (from_mean(x, n, total) / n).astype(float) if x.dtype.kind == "i" else x - np.array(total) / n
            made = (z * w[:, None]).T @ z + (0 if made is None else made)
        if made is not None:
            i, j = np.triu_indices(len(made))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(made[i, j])], names=["i", "j", "v"])

    parts = df.select(column, weight).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(total), len(total)))
    for r in parts:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


@dataclass
class Fit:
    """Sum of weights, exact weighted sums, unit eigenvectors (columns) and eigenvalues by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float


def fit(distinct: DataFrame, components: int) -> Fit:
    """Eigenvectors of the weighted covariance of the ``x`` vectors."""
    n, total = sums(distinct, "x", "w")
    cov = centred_product(distinct, "x", "w", n, total) / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    return Fit(n, total, axes[:, order], np.maximum(values[order], 0), float(np.trace(cov)))


def integer_vectors(vectors: DataFrame, scale: int, column: str) -> DataFrame:
    """``(vec_id, x, k1, k2, slice)`` of the rows that take part; ``x`` still lacks the offset."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)
    common = whole.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform(column, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    rows = whole.where(F.size(column) == (common["d"] if common else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.select("*", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"), F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)).cast("int").alias("slice"))


def whiten_distinct(distinct: DataFrame, found: Fit) -> DataFrame:
    """Every distinct vector once, in the space of the components that have variance."""
    live = found.values > found.values.max(initial=0) * len(found.sums) * np.finfo(float).eps
    to = found.axes[:, live] / np.sqrt(found.values[live])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            far = from_mean(matrix(got.column(0)), found.n, found.sums)
            made = (far / found.n).astype(float) @ to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * to.shape[1], pa.int32()), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*got.columns[1:], pa.array(deviations(far), pa.int64()), lists], schema=WHITENED)

    return distinct.select("x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"), F.col("w").cast("long").alias("w"), "slices").mapInArrow(
        run, "k1 long, k2 long, w long, slices long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, weights: str = "one", column: str = "embedding") -> DataFrame:
    """``RESULT`` rows: every row of ``vectors`` that takes part, on each component; ``weights``: "one" or "count"."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale, column)
    once, done = cm.scratch_table(spark, "whitening-distinct"), cm.scratch_table(spark, "whitening-done")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slice"))
    weight = {"one": F.lit(1).cast("long"), "count": F.count("*")}[weights]
    rows.groupBy("x").agg(weight.alias("w"), F.bit_or(bit).alias("slices")).write.parquet(once)
    distinct = spark.read.parquet(once)
    if distinct.isEmpty():
        return spark.createDataFrame([], RESULT)
    found = fit(distinct, components)
    whiten_distinct(distinct, found).write.parquet(done)
    cm.drop_table(spark, once)
    whitened = spark.read.parquet(done)
    n, total = sums(whitened, "whitened", "w", float)
    error = float(np.abs(centred_product(whitened, "whitened", "w", n, total) / n - np.eye(len(total))).max(initial=0))
    shares = found.values / found.trace if found.trace else found.values
    copies = whitened.select("k1", "k2", "deviation", "whitened", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda s: F.call_function("getbit", F.col("slices"), s) == 1)).alias("slice"))
    each = F.posexplode(F.array(*[
        F.struct(F.get("whitened", F.lit(k)).alias("whitened"), F.lit(float(s)).alias("explained")) for k, s in enumerate(shares)])).alias("k", "c")
    return rows.select("vec_id", "k1", "k2", "slice").join(copies, ["k1", "k2", "slice"]).select("vec_id", "deviation", each).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).alias("identity_error"))
