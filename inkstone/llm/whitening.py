"""Whitening of embeddings: principal components from an SVD of centred distributed rows.

Entries become integers x, so that the number of vectors n, the sums S and each row's deviation, the sum of (n x - S)^2, are
exact. MLlib's ``computeSVD`` runs over rows (x - S/n); its singular values s give the eigenvalues s^2 / n of the covariance.
The driver holds a Gramian of the dimensions, never rows.

Defined results: vectors that are null or hold null, NaN or infinite entries take no part. Vectors of another length than the
most frequent one (ties: the longer) take no part either. A null id and repeated rows or ids are rows like others; equal vectors
give equal results. Entries beyond 2^40 in size after scaling count as that. A component whose singular value is below
``LEAST`` of the largest is left out: it can't be told from rounding, and there is no scale to give it. So a table of equal
vectors, one vector or none gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.memory import release
from inkstone.llm.scratch import Scratch

SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**40
COMPONENTS = 32
#: Singular values below this part of the largest are noise of the Gramian in double precision.
LEAST = 1e-6


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S; components as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.variance for e in self.eigenvalues]


def integers(vector: Column) -> Column:
    """array<bigint>; null for vectors that take no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET)
    return F.when(vector.isNotNull() & ~bad, scaled)


def prepared(vectors: DataFrame, scratch: Scratch, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and integers ``x`` of the vectors that take part, written once."""
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    rows = scratch.keep(rows, "integers")
    most = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return rows.where(F.size("x") == (most["dims"] if most else 0))


def fit(spark: SparkSession, rows: DataFrame, k: int = COMPONENTS) -> Fit | None:
    """None where nothing varies."""
    entries = rows.select(F.posexplode("x").alias("dim", "x"))
    sums = entries.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("dim").collect()
    if not sums:
        return None
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    centred = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(_centred(F.col("x"), n, s)).alias("v")), "v")
    # the exact deviations, as a sum of their own: not from the singular values
    total = rows.mapInArrow(_deviations(n, s), "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0]
    variance = int(total) / n**3
    if not variance:
        return None
    svd = RowMatrix(centred, 0, len(s)).computeSVD(min(k, len(s)), computeU=False, rCond=LEAST)
    values = np.asarray(svd.s.toArray())
    return Fit(n, np.array(s, dtype=object), np.asarray(svd.V.toArray())[:, : len(values)], values**2 / n, variance)


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """(n x - S) / n: the difference is exact, then divided once."""
    parts = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    # products beyond 2^63 are possible only with more than 2^22 vectors of the largest entries
    return F.zip_with(x, parts, lambda a, s: ((a.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")).cast("decimal(38,0)") - s).cast("double") / n)


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, as 64-bit integers where all of them fit, else as Python's."""
    largest = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * largest + max(abs(int(s)) for s in sums) < 2**62:
        return x * n - np.array([int(s) for s in sums], dtype=np.int64)
    return x.astype(object) * n - sums


def deviations(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    largest = max(int(d.max()), -int(d.min())) if d.size else 0
    return [int(v) for v in ((d if largest**2 * d.shape[1] < 2**62 else d.astype(object)) ** 2).sum(axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, dims)


def _deviations(n: int, sums: list[int]):
    s = np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(deviations(differences(_matrix(batch.column("x"), len(s)), n, s)))
            yield pa.RecordBatch.from_arrays([_decimals([total])], ["deviation"])

    return run


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def project(rows: DataFrame, model: Fit) -> DataFrame:
    """``id``, the exact ``deviation`` and the ``whitened`` entries of each row."""
    n, sums, weights = model.n, model.sums, model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = differences(_matrix(batch.column("x"), len(sums)), n, sums)
            w = (d.astype(np.float64) / n) @ weights
            entries = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _decimals(deviations(d)), entries], ["id", "deviation", "whitened"])
        release()

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance (divisor n) of whitened rows minus the identity."""
    vectors = MLUtils.convertVectorColumnsFromML(whitened.select(array_to_vector("whitened").alias("v")), "v")
    covariance = np.asarray(RowMatrix(vectors).computeCovariance().toArray()) * (n - 1) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Fit | None, float | None]:
    """Rows of :func:`project`, the fit and the identity error. No rows, and None, where nothing varies."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = prepared(vectors, scratch, id_col, vector_col)
    model = fit(spark, rows, k)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, deviation decimal(38,0), whitened array<double>"), None, None
    out = scratch.keep(project(rows, model), "whitened")
    scratch.drop_all_but("whitened")
    return out, model, identity_error(out, model.n)


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, numbered from 1: ``vec_id component n deviation whitened explained identity_error``."""
    rows, model, error = whiten(vectors, id_col, vector_col, k)
    explained = F.array(*[F.lit(e) for e in model.explained]) if model else F.array().cast("array<double>")
    out = rows.select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select(
        F.col("id").alias("vec_id"),
        (F.col("i") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation"),
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
