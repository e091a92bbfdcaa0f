"""Whitening of embeddings by a covariance that is aggregated exactly, as squares alone.

Entries become integers. Of each dimension and of each sum of two dimensions, the squares of centred values are added up; a
sum's variance less those of its two dimensions is twice their covariance (polarisation), so one kind of aggregate gives the whole
matrix. Values are centred at the integer below the mean; what is left of the mean, less than one, is taken out of the
sums by integer arithmetic, so nothing is rounded before the covariances are divided by n. The matrix is of the size of a vector
squared, whatever the number of rows, and is decomposed by ``eigh``.

Tasks add up whole batches and give one number for each position, in limbs of 32 bits, which Spark adds as longs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import slices

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries from here on count as not finite: scaled, they would no longer be exact.
FINITE = 2.0**42
LIMBS = 5
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What is fitted: count and exact sums of the integer vectors, their covariance, and its leading components (columns of ``axes``)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integers below the means."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """The sums of what is left of each dimension around the centre, each less than n."""
        return [s % self.n for s in self.sums]

    @property
    def explained(self) -> np.ndarray:
        """The share of the whole variance that each component has."""
        return self.values / np.trace(self.covariance)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that have a vector of finite entries; of vectors of several lengths those of the most frequent one (of equals the longest)."""
    v = F.col(vector).cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < FINITE, F.lit(False))))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("v") == (sizes["d"] if sizes else 0))


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The integer vectors of a batch, a row for each dimension."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(-1, d).T.copy()


def _limbs(values: np.ndarray) -> list[pa.Array]:
    """Integers of any size as limbs of 32 bits, of which the last has the sign."""
    rest, out = [int(v) for v in values], []
    for _ in range(LIMBS - 1):
        out.append(pa.array([v & 0xFFFFFFFF for v in rest], pa.int64()))
        rest = [v >> 32 for v in rest]
    return [*out, pa.array(rest, pa.int64())]


def _exact(x: np.ndarray, bits: int) -> np.ndarray:
    """``x`` as Python's integers, unless what is to be made of it has so many bits at most."""
    return x if bits <= 62 else x.astype(object)


def _bits(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0)).bit_length()


def _sums(x: np.ndarray) -> np.ndarray:
    return _exact(x, _bits(x) + x.shape[1].bit_length()).sum(axis=1)


def _squares(y: np.ndarray) -> np.ndarray:
    """The sums of squares of each dimension, and then of each pair's sums, pairs in the order of ``triu_indices``."""
    y = _exact(y, 2 * (_bits(y) + 1) + y.shape[1].bit_length())
    added = lambda t: np.einsum("ij,ij->i", t, t) if t.dtype != object else (t * t).sum(axis=1)
    return np.concatenate([added(y), *(added(y[i] + y[i + 1 :]) for i in range(len(y) - 1))])


def _added(rows: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray]) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sums of what ``make`` gives for the integer vectors of each batch."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in slices(batches, 8192):
            n += batch.num_rows
            total = total + make(_integers(batch, d)).astype(object)
        if n:
            values = np.append(total, n)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *_limbs(values)], names=["pos", *(f"l{k}" for k in range(LIMBS))])

    names = [f"l{k}" for k in range(LIMBS)]
    found = rows.select("v").mapInArrow(part, "pos int, " + ", ".join(f"{x} long" for x in names)).groupBy("pos").agg(*(F.sum(x).alias(x) for x in names)).orderBy("pos").collect()  # a row for each position
    values = [sum(r[x] << 32 * k for k, x in enumerate(names)) for r in found]
    return (values[-1], values[:-1]) if values else (0, [])


def covariance_of(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix (divisor n) from the sums around a centre and the sums of squares; each entry is rounded once."""
    d = len(rest)
    left, right = np.triu_indices(d, 1)
    spread = [n * q - t * t for q, t in zip(squares, rest, strict=False)]
    out = np.diag([s / n**2 for s in spread])
    for q, i, j in zip(squares[d:], left.tolist(), right.tolist(), strict=True):
        out[i, j] = out[j, i] = (n * q - (rest[i] + rest[j]) ** 2 - spread[i] - spread[j]) / (2 * n**2)
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of ``usable``'s rows; None where there are none. Components without variance (to double precision) are left out."""
    first = vectors.first()
    d = len(first["v"]) if first else 0
    n, sums = _added(vectors, d, _sums) if d else (0, [])
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))
    centre = model.centre[:, None]
    model.covariance = covariance_of(n, model.rest, _added(vectors, d, lambda x: _squares(x - centre))[1])
    values, axes = np.linalg.eigh(model.covariance)
    kept = [k for k in range(d - 1, -1, -1) if values[k] > d * np.finfo(float).eps * values[-1]][:components]
    axes = axes[:, kept]
    model.values, model.axes = values[kept], axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(kept))])
    return model


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """A row for each vector, a column for each component."""
    centred = (x - model.centre[:, None]).astype(float) - (np.array(model.rest, object) / model.n).astype(float)[:, None]
    return centred.T @ (model.axes / np.sqrt(model.values))


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Of each vector the exact sum of (n * x - S) squared; null where it is beyond a long."""
    y = x - model.centre[:, None]
    y = _exact(y, 2 * (_bits(y) + model.n.bit_length() + 1) + len(y).bit_length())
    off = model.n * y - np.array(model.rest, y.dtype)[:, None]
    return pa.array([int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=0)], pa.int64())


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity."""
    d, k = len(model.sums), len(model.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in slices(batches, 8192):
            z = _projected(_integers(batch, d), model)
            total += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["pos", "x"])

    found = vectors.select("v").mapInArrow(part, "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
    total = np.array([r["x"] for r in found]) / model.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the leading components of each vector.

    Rows whose vector is null, or has a null, non-finite or huge entry (``FINITE``), are left out, and so are vectors of another length than the most
    frequent one. Rows that repeat count each and are returned each, a null vec_id stays null. Components without variance, as of
    equal vectors, are left out: their scale would be infinite. An empty table, or one without usable vectors, gives an empty one. Other columns aren't
    read. Four passes over the table: lengths, sums, squares, check of the result; the rows themselves never move.
    """
    vectors = usable(rows, vector)
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], WHITENED)
    error, d, k = identity_error(vectors, model), len(model.sums), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x, n = _integers(batch, d), batch.num_rows
            row, each = pa.array(np.repeat(np.arange(n), k)), lambda v: pa.array(np.tile(v, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(row), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(n * k, model.n)), _deviations(x, model).take(row), pa.array(_projected(x, model).ravel()), each(model.explained), pa.array(np.full(n * k, error))],
                names=[x.split()[0] for x in WHITENED.split(", ")],
            )

    return vectors.mapInArrow(project, WHITENED)
