"""Whitening of embeddings by an incremental eigendecomposition, refined once over all rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.functions.durable import shared_folder
from tapewright.llm.spectra import Spectrum
from tapewright.llm.vectors import longest, matrix, padded, scaled, usable

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Spectra that one task combines; rows condensed together, in multiples of the columns.
FAN_IN, BLOCK_COLUMNS = 16, 16

SPECTRUM = "part long, n long, mean binary, eigenvalues binary, eigenvectors binary"


@dataclass(frozen=True)
class Model:
    """What the rows share; its size is that of the covariance, whatever the number of rows."""

    n: int  # distinct vectors
    whole: np.ndarray  # the sums are n * whole + rest, with 0 <= rest < n
    rest: np.ndarray
    values: np.ndarray  # falling eigenvalues of the covariance
    vectors: np.ndarray  # their unit eigenvectors, as columns
    rank: int  # leading components with variance
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def loads(self, k: int) -> np.ndarray:
        """Columns that whiten a centred row; those of components without variance are zero."""
        out = np.zeros((len(self.whole), k))
        r = min(k, self.rank)
        out[:, :r] = self.vectors[:, :r] / np.sqrt(self.values[:r])
        return out


def whole_rows(df: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): the usable rows of (vec_id, embedding), with whole-number vectors."""
    return df.filter(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), scaled(F.col("embedding"), scale, shift).alias("x"))


def summed(parts: DataFrame) -> np.ndarray:
    """(cell, value) rows of all tasks added up by cell; as many rows reach the driver as there are cells."""
    out = parts.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toArrow()
    return out["value"].to_numpy()


def per_task(size: int, kind: str, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], None]):
    """A function for mapInArrow: one array of sums for each task, as (cell, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start()
        for b in batches:
            if b.num_rows:
                add(total, matrix(b["x"], size))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(kind))], ["cell", "value"])

    return run


def spectra_of(fit: DataFrame, size: int, whole: np.ndarray) -> DataFrame:
    """One spectrum for each partition of `fit`, brought up to date block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, step = Spectrum.empty(size), max(1024, BLOCK_COLUMNS * size)
        for b in batches:
            x = matrix(b["x"], size) - whole
            for at in range(0, len(x), step):
                s.add(x[at : at + step].astype(float))
        if s.n:
            yield pa.RecordBatch.from_pylist([packed(s, TaskContext.get().partitionId())])

    return fit.mapInArrow(run, SPECTRUM)


def packed(s: Spectrum, part: int) -> dict:
    return {"part": part, "n": s.n, "mean": s.mean.tobytes(), "eigenvalues": s.values.tobytes(), "eigenvectors": np.ascontiguousarray(s.vectors).tobytes()}


def unpacked(r) -> Spectrum:
    mean, values = (np.frombuffer(b) for b in (r.mean, r.eigenvalues))
    return Spectrum(int(r.n), mean, values, np.frombuffer(r.eigenvectors).reshape(len(mean), len(mean)))


def combine(group: pd.DataFrame) -> pd.DataFrame:
    rows = list(group.sort_values("part").itertuples())
    out = unpacked(rows[0])
    for r in rows[1:]:
        out.merge(unpacked(r))
    return pd.DataFrame([packed(out, rows[0].part // FAN_IN)])


def one_spectrum(spectra: DataFrame, folder: str) -> Spectrum:
    """All spectra combined, FAN_IN at a time; each level is written to shared storage."""
    spark = spectra.sparkSession
    level = 0
    while True:
        spectra.write.parquet(path := os.path.join(folder, f"level-{level}"))
        spectra = spark.read.parquet(path)
        if spectra.count() <= 1:
            return unpacked(spectra.first())
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(combine, SPECTRUM)
        level += 1


def fit(rows: DataFrame, components: int = 16) -> Model | None:
    """The model of the distinct vectors of `rows` (id, x); None where there are none, or only empty ones.

    Every partition keeps the spectrum of its rows by centred rank-one updates, the spectra are combined by
    further ones, and the eigenvectors found so are the basis of one Rayleigh-Ritz step: the covariance in that basis is added up
    over all rows, about the exact mean, and its small eigenproblem turns the basis into the components. The identity error
    is measured by whitening all rows once more. The driver holds matrices of the size of the covariance.
    """
    spark = rows.sparkSession
    size = longest(rows, "x")
    folder = shared_folder(spark, "whitening")
    rows.select("x").distinct().write.parquet(f"{folder}/fit")
    fit_rows = spark.read.parquet(f"{folder}/fit")
    n = fit_rows.count()
    if not n or not size:
        return None
    add_up = lambda total, x: np.add(total, x.sum(0), out=total)
    sums = summed(fit_rows.mapInArrow(per_task(size, "int64", lambda: np.zeros(size, np.int64), add_up), "cell long, value long"))
    whole, rest = np.divmod(sums, n)
    basis = np.linalg.qr(one_spectrum(spectra_of(fit_rows, size, whole), folder).vectors)[0]

    def covariance(load: np.ndarray) -> np.ndarray:
        """Mean product of the centred rows times `load` with themselves, over all rows."""
        k = load.shape[1]

        def add(total: np.ndarray, x: np.ndarray) -> None:
            y = ((x - whole) - rest / n) @ load
            total += y.T @ y

        return summed(fit_rows.mapInArrow(per_task(size, "float64", lambda: np.zeros((k, k)), add), "cell long, value double")).reshape(k, k) / n

    ritz = covariance(basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), basis @ turn[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(size)] < 0, -1, 1)
    rank = int((values > 64 * size * np.finfo(float).eps * values[0]).sum()) if values[0] > 0 else 0
    model = Model(n, whole, rest, values, vectors, rank, float(values.sum()), 0.0)
    k = min(components, size, rank)
    error = float(np.abs(covariance(model.loads(k)) - np.eye(k)).max()) if k else 0.0
    return Model(n, whole, rest, values, vectors, rank, model.trace, error)


def transform(rows: DataFrame, model: Model, components: int = 16) -> DataFrame:
    """`rows` (id, x) with `whitened`, an array of the leading components, and `deviation`, the sum of (n * x - sum)^2.

    A component without variance is 0. A deviation beyond 64 bits is null.
    """
    size = len(model.whole)
    load = model.loads(min(components, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["x"], size)
            off = x - model.whole
            far = model.n * (np.abs(off).max(initial=0) + 1.0)
            if size * far**2 < 2**62:
                deviation = pa.array(((model.n * off - model.rest) ** 2).sum(1))
            else:
                exact = ((model.n * off.astype(object) - model.rest.astype(object)) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
            y = model.centred(x) @ load
            whitened = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays([b["id"], deviation, whitened], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


EMPTY = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def prepared(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The usable rows in shared storage, all of one length: a shorter vector is filled up as if its entries were 0."""
    path = shared_folder(spark, "whole-vectors")
    whole_rows(df).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.withColumn("x", padded(F.col("x"), longest(rows, "x"), SHIFT))


def digest(df: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and leading component.

    `df` has (vec_id, embedding); other columns are left behind. Rows whose vector is null or has a null entry, or one that is not
    finite, are left out. Repeated rows each have their result but count once in the model. Components without variance
    are 0, their explained share too. An empty table has an empty result.
    """
    spark = df.sparkSession
    rows = prepared(df, spark)
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], f"vec_id {df.schema['vec_id'].dataType.simpleString()}, {EMPTY}")
    shares = [float(v) / model.trace if model.trace and i < model.rank else 0.0 for i, v in enumerate(model.values[:components])]
    out = transform(rows, model, components).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]), F.col("at"))
    return out.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
