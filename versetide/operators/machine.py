"""Factorisation machine of second order, fitted on written rows of places and values.

Spark's ``FMClassifier`` makes a dense gradient of all coefficients for every row
of every step. Here a task adds up the gradient of a block of rows as products of
matrices over the places that the block has, and gives one row for each
coefficient; loss, start, steps and stop are those of the estimator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.session import emptied, spread

# Sums of gradients are made in whole units of this part, so any order of a sum gives the same.
UNIT = 2.0**30
# Values of a block of rows, at most.
CELLS = 1 << 17
# Places, and rows at most, that are packed together, about: readers hold thousands of packed rows at once.
PACKED = 1 << 7
# Places of the rows that a task looks at together, about.
PIECE = 1 << 18
BETA1, BETA2, EPSILON, TOLERANCE = 0.9, 0.999, 1e-8, 1e-6  # fixed values of the estimator


def _flat(places: pa.Array, values: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ends of the rows of an Arrow batch, their places one after the other, and the values at these."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))])
    return ends, places.flatten().to_numpy(zero_copy_only=False), None if values is None else values.flatten().to_numpy(zero_copy_only=False)


def blocks(ends: np.ndarray, where: np.ndarray, held: np.ndarray | None, size: int):
    """(start, stop, names, matrix) of parts of the rows of ``_flat``: the places they have, and their values at these.

    A part has at most CELLS values, or is one row. Without values each place holds a 1.
    """
    number = np.empty(size, np.int64)
    waiting = [(0, len(ends) - 1)]
    while waiting:
        start, stop = waiting.pop()
        cells = slice(ends[start], ends[stop])
        there = np.zeros(size, bool)
        there[where[cells]] = True
        names = np.flatnonzero(there)
        if (stop - start) * len(names) > CELLS and stop - start > 1:
            middle = (start + stop) // 2
            waiting += [(middle, stop), (start, middle)]
            continue
        number[names] = np.arange(len(names))
        matrix = np.zeros((stop - start, len(names)))
        row = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
        matrix[row, number[where[cells]]] = 1.0 if held is None else held[cells]
        yield start, stop, names, matrix


def _packed(places: str, values: str | None, label: str):
    """Rows as bytes, about PACKED places in each, so that a step moves them without taking them apart."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, where, held = _flat(batch.column(places), None if values is None else batch.column(values))
            told = batch.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
            number = ends[:-1] // PACKED + np.arange(batch.num_rows) // PACKED
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [batch.num_rows]])
            parts = (
                (np.diff(ends).astype(np.int32), cuts), (where.astype(np.int32), ends[cuts]),
                (np.empty(0), 0 * cuts) if held is None else (held.astype(np.float64), ends[cuts]), (told, cuts),
            )
            yield pa.RecordBatch.from_arrays([_bytes(x, at) for x, at in parts], ["lengths", "places", "held", "told"])

    return pack


def _bytes(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column of the bytes of ``values`` between each two ``cuts``."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind) -> np.ndarray:
    """The numbers of a column of ``_bytes``, those of all rows one after the other."""
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, kind)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize)
    return np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0])


def _pieces(batch: pa.RecordBatch, valued: bool):
    """(ends, places, values, labels) of packed rows, about PIECE places in each."""
    lengths, where, told = _values(batch.column("lengths"), np.int32), _values(batch.column("places"), np.int32), _values(batch.column("told"), np.float64)
    held = _values(batch.column("held"), np.float64) if valued else None
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECE, "right")) - 1)
        cells = slice(ends[start], ends[stop])
        yield ends[start : stop + 1] - ends[start], where[cells], None if held is None else held[cells], told[start:stop]
        start = stop


def _margin(rows: np.ndarray, squares: np.ndarray, w: np.ndarray, intercept: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins of ``rows``, and their sums of the columns of ``w``: linear weight, then factors."""
    sums = rows @ w
    pairs = (sums[:, 1:] ** 2).sum(axis=1) - squares @ (w[:, 1:] ** 2).sum(axis=1)
    return intercept + sums[:, 0] + pairs / 2, sums


def gradient(
    ends: np.ndarray, where: np.ndarray, held: np.ndarray | None, label: np.ndarray, w: np.ndarray, scales: np.ndarray
) -> np.ndarray:
    """Sum over the rows of the gradient of the logistic loss, shaped as ``w``: a row for each place, the last has the intercept."""
    found = np.zeros_like(w)
    for start, stop, names, rows in blocks(ends, where, held, len(scales)):
        if held is not None:
            rows *= scales[names]
        squares, some = rows if held is None else rows * rows, w[names]
        margin, sums = _margin(rows, squares, some, w[-1, 0])
        slope = 1 / (1 + np.exp(-margin)) - label[start:stop]
        sums[:, 0] = 1
        part = rows.T @ (sums * slope[:, None])
        part[:, 1:] -= some[:, 1:] * (squares.T @ slope)[:, None]
        found[names] += part
        found[-1, 0] += slope.sum()
    return found


@dataclass
class Machine:
    """Fitted weights, shaped as in ``gradient``, with the scales of the places already in them."""

    weights: np.ndarray

    def score(self, places: str, values: str | None = None) -> Column:
        """The probability of label 1."""
        weights = self.weights

        def told(where: pa.Array, held: pa.Array | None = None) -> pa.Array:
            found = np.empty(len(where))
            for start, stop, names, rows in blocks(*_flat(where, held), len(weights) - 1):
                margin, _ = _margin(rows, rows if held is None else rows * rows, weights[names], weights[-1, 0])
                found[start:stop] = 1 / (1 + np.exp(-margin))
            return pa.array(found)

        if values is None:
            def ones(where: pa.Array) -> pa.Array:
                return told(where)

            return F.arrow_udf(ones, "double")(places)

        def valued(where: pa.Array, held: pa.Array) -> pa.Array:
            return told(where, held)

        return F.arrow_udf(valued, "double")(places, values)

    def save(self, path: str) -> None:
        """Write the weights under ``path``."""
        spark = SparkSession.getActiveSession()
        rows = [(place, [float(x) for x in row]) for place, row in enumerate(self.weights)]
        spark.createDataFrame(rows, "place int, weights array<double>").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Machine":
        """Read saved weights."""
        return Machine(np.array([row["weights"] for row in spark.read.parquet(path).orderBy("place").collect()]))


def _start(spark: SparkSession, size: int, factors: int, seed: int) -> np.ndarray:
    """The estimator's first weights: what it returns after no step."""
    one = spark.createDataFrame([(SparseVector(size, {}), 0.0)], ["features", "label"])
    model = FMClassifier(factorSize=factors, maxIter=0, seed=seed).fit(one)
    w = np.zeros((size + 1, factors + 1))
    w[:-1, 0], w[:-1, 1:], w[-1, 0] = model.linear.toArray(), model.factors.toArray(), model.intercept
    return w


def _scales(df: DataFrame, places: str, values: str, size: int) -> np.ndarray:
    """What each place is multiplied by, so that its largest value is 1."""
    cells = df.select(F.explode(F.arrays_zip(F.col(places).alias("p"), F.col(values).alias("v"))).alias("c"))
    scales = np.ones(size)
    for row in cells.groupBy("c.p").agg(F.max(F.abs("c.v")).alias("most")).collect():  # one for each place
        if row["most"] > 0:
            scales[row["p"]] = 1 / row["most"]
    return scales


def fit_machine(
    df: DataFrame, size: int, places: str, values: str | None = None, label: str = "label",
    factors: int = 8, steps: int = 50, step_size: float = 0.05, seed: int = 7,
) -> Machine:
    """Fit on all rows of ``df`` in each step; they are packed and written once. Without ``values`` each place holds a 1."""
    w = _start(df.sparkSession, size, factors, seed)
    scales = np.ones(size) if values is None else _scales(df, places, values, size)
    columns = [places, label] if values is None else [places, values, label]
    rows = spread(df.select(*columns).mapInArrow(_packed(places, values, label), "lengths binary, places binary, held binary, told binary"), "packed")
    total = int(rows.agg(F.sum(F.octet_length("told"))).first()[0] or 0) // 8
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        def partial(batches, w=w):
            found = np.zeros_like(w)
            for batch in batches:
                for piece in _pieces(batch, values is not None):
                    found += gradient(*piece, w, scales)
            units = np.rint(found.ravel() * UNIT).astype(np.int64)
            there = np.flatnonzero(units)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(units[there])], ["at", "units"])

        sums = rows.mapInArrow(partial, "at bigint, units bigint").groupBy("at").agg(F.sum("units").alias("units")).toArrow()
        found = np.zeros(w.size)
        found[sums.column("at").to_numpy()] = sums.column("units").to_numpy() / (UNIT * max(1, total))
        found = found.reshape(w.shape)
        first = BETA1 * first + (1 - BETA1) * found
        second = BETA2 * second + (1 - BETA2) * found**2
        before, w = w, w - step_size * (first / (1 - BETA1**step)) / (np.sqrt(second / (1 - BETA2**step)) + EPSILON)
        if np.linalg.norm(w - before) < TOLERANCE * max(np.linalg.norm(w), 1.0):
            break
    emptied(rows)
    w[:-1] *= scales[:, None]
    return Machine(w)
