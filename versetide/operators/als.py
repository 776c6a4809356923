"""Factors by additive normal equations, for many settings in one sweep.

A half-step gives each key of one side the vector that fits its ratings best,
with the vectors of the other side held: the Gram matrix of those vectors and
their products with the ratings are sums, so they add up from any parts of the
ratings. A key's ratings lie in blocks of a bounded number; a key with one block
is solved where the block is read, and one with more sends a sum for each block
and is solved from their total. So a hot user or item is many tasks' work.

A ``Setting`` is a regularisation and a fold that is left out. Vectors of all
settings travel as one row, so one sweep over the ratings serves them all, and a
longer fit goes on from a shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import digest
from versetide.session import broadcast_if_small, settle

#: Ratings of a key in one block, about.
BLOCK_RATINGS = 1 << 14
#: Bytes of the other side's vectors that are sent to every task; larger ones are joined.
SENT_BYTES = 64 << 20
NO_FOLD = -1


@dataclass(frozen=True)
class Setting:
    """One fit: its regularisation, and the fold that it does not see."""

    reg: float
    fold: int = NO_FOLD


def blocks(ratings: DataFrame, key: str, other: str, size: int = BLOCK_RATINGS) -> DataFrame:
    """(key, parts, others, values, folds): the ratings of each key in blocks, written.

    ``ratings`` has ``values``, an array with a number for each fold's fit, and
    ``fold``. Keys with more than ``size`` ratings have several rows. The order
    inside a block is that of the other id.
    """
    counts = ratings.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    several = settle(counts.where("parts > 1"), "hot-keys")
    part = F.pmod(F.xxhash64(other), F.col("parts")).cast("int")
    rows = ratings.join(broadcast_if_small(several, 32), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entry = F.struct(F.col(other).alias("other"), F.col("fold").alias("fold"), F.col("values").alias("values"))
    grouped = rows.groupBy(F.col(key).alias("key"), part.alias("part")).agg(
        F.max("parts").alias("parts"), F.array_sort(F.collect_list(entry)).alias("entries")  # about ``size`` entries
    )
    return settle(
        grouped.select("key", "parts", F.col("entries.other").alias("others"), F.flatten("entries.values").alias("values"),
                       F.col("entries.fold").alias("folds")), "rating-blocks",
    )


def first_vectors(keys: DataFrame, key: str, rank: int, settings: int = 1) -> DataFrame:
    """(id, vec): small numbers from the digest of the id, the same for every setting."""
    def number(place: int) -> Column:
        return (F.conv(F.substring(digest(f"factor-{place}", key), 1, 4), 16, 10).cast("double") / 65535 - 0.5) / rank**0.5

    one = F.array(*(number(i) for i in range(rank)))
    return keys.select(F.col(key).alias("id"), F.flatten(F.array_repeat(one, settings)).alias("vec"))


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Sums:
    """Normal equations of all settings for one key."""

    def __init__(self, settings: list[Setting], rank: int):
        self.rank, self.count = rank, len(settings)
        self.regs = np.array([s.reg for s in settings])
        self.left_out = np.array([s.fold for s in settings])
        # the column of values that a setting fits
        self.column = np.maximum(self.left_out, 0)
        self.upper = np.triu_indices(rank)

    def add(self, vectors: np.ndarray, values: np.ndarray, folds: np.ndarray) -> np.ndarray:
        """Sums of the rows (ratings, settings x rank): triangle of the Gram matrix, products, count, for each setting."""
        seen = (folds[None, :] != self.left_out[:, None]).astype(float)
        x = vectors.reshape(len(vectors), self.count, self.rank).transpose(1, 0, 2)
        used = x * seen[:, :, None]
        gram = used.transpose(0, 2, 1) @ x
        target = np.einsum("snr,sn->sr", used, values[:, self.column].T)
        return np.concatenate([gram[:, self.upper[0], self.upper[1]], target, seen.sum(axis=1)[:, None]], axis=1)

    def solve(self, sums: np.ndarray) -> np.ndarray:
        """Vectors of all settings; a setting that saw no rating has zeros."""
        triangle = len(self.upper[0])
        gram = np.zeros((self.count, self.rank, self.rank))
        gram[:, self.upper[0], self.upper[1]] = sums[:, :triangle]
        gram += np.triu(gram, 1).transpose(0, 2, 1)
        count = sums[:, -1]
        place = np.arange(self.rank)
        gram[:, place, place] += np.where(count > 0, self.regs * count, 1.0)[:, None]
        return np.linalg.solve(gram, sums[:, triangle:-1, None])[:, :, 0].ravel()


def _block_rows(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    others, values, marks = (batch.column(c) for c in ("others", "values", "folds"))
    for k, (key, parts) in enumerate(zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist())):
        yield key, parts, others[k].values.to_numpy(zero_copy_only=False), values[k].values.to_numpy(zero_copy_only=False).reshape(-1, columns), \
            marks[k].values.to_numpy(zero_copy_only=False)


SUMS = "id bigint, parts int, sums array<double>"


def _summer(settings: list[Setting], rank: int, columns: int, lookup):
    """(id, parts, sums) of each block; solved already where the block is all of its key."""

    def run(batches):
        math = _Sums(settings, rank)
        for batch in batches:
            vectors_of = lookup()
            for start in range(0, batch.num_rows, 64):
                ids, parts, out = [], [], []
                for key, count, others, values, marks in _block_rows(batch.slice(start, 64), columns):
                    place, vectors = vectors_of(others)
                    sums = math.add(vectors, values[place], marks[place])
                    ids.append(key)
                    parts.append(count)
                    out.append(math.solve(sums) if count == 1 else sums.ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["id", "parts", "sums"]
                )

    return run


def _sent(table: pa.Table, width: int, context):
    """Lookup of rows of vectors by id, from a table that every task has."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    shared = context.broadcast((table.column("id").to_numpy()[order], _matrix(table.column("vec"), width)[order]))

    def lookup():
        ids, matrix = shared.value

        def of(others):
            if not len(ids):
                return np.zeros(0, np.int64), np.zeros((0, width))
            at = np.minimum(np.searchsorted(ids, others), len(ids) - 1)
            known = np.flatnonzero(ids[at] == others)
            return known, matrix[at[known]]

        return of

    return lookup


def _joined_summer(settings: list[Setting], rank: int, columns: int):
    """Sums of rows that bring their own vector and come in order of their key; a task's rows of a key are one row."""

    def run(batches):
        math, key, parts, total = _Sums(settings, rank), None, 0, None
        for batch in batches:
            ids = batch.column("key").to_numpy(zero_copy_only=False)
            vectors, values = _matrix(batch.column("vec"), len(settings) * rank), _matrix(batch.column("values"), columns)
            marks = batch.column("fold").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            done = []
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if key is not None and ids[a] != key:
                    done.append((key, total))
                    total = None
                key = ids[a]
                sums = math.add(vectors[a:b], values[a:b], marks[a:b])
                total = sums if total is None else total + sums
            if done:
                yield _sum_rows(done)
        if key is not None:
            yield _sum_rows([(key, total)])

    return run


def _sum_rows(done: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([int(k) for k, _ in done], pa.int64()), pa.array([2] * len(done), pa.int32()), pa.array([s.ravel() for _, s in done], pa.list_(pa.float64()))],
        ["id", "parts", "sums"],
    )


def _solver(settings: list[Setting], rank: int):
    """(id, vec) from the sums of each key, which come one behind the other."""

    def run(batches):
        math, key, total = _Sums(settings, rank), None, None
        for batch in batches:
            ids, vecs = [], []
            for k, sums in zip(batch.column("id").to_pylist(), batch.column("sums")):
                sums = sums.values.to_numpy(zero_copy_only=False).reshape(len(settings), -1)
                if k == key:
                    total = total + sums
                    continue
                if key is not None:
                    ids.append(key)
                    vecs.append(math.solve(total))
                key, total = k, sums
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64()))], ["id", "vec"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([math.solve(total)], pa.list_(pa.float64()))], ["id", "vec"])

    return run


def half_step(
    ratings: DataFrame, held: DataFrame, rank: int, settings: list[Setting], columns: int = 1, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """(id, vec) of every key of ``ratings``, a table of ``blocks``, from the written vectors ``held`` of the other side.

    The regularisation counts once for each rating. Ratings whose other side has
    no vector are left out.
    """
    width = len(settings) * rank
    if held.count() * (width + 1) * 8 <= sent_bytes:
        lookup = _sent(held.select("id", "vec").toArrow(), width, held.sparkSession.sparkContext)  # sent_bytes at most
        found = settle(ratings.mapInArrow(_summer(settings, rank, columns, lookup), SUMS), "normal-sums")
        whole = found.where("parts = 1").select("id", F.col("sums").alias("vec"))
        pieces = found.where("parts > 1").select("id", "sums")
        if not pieces.take(1):
            return whole
    else:
        rows = _entries(ratings, columns)
        near = settle(rows.join(held, "id").select("key", "vec", "values", "fold"), "rated-vectors")
        # dealt by key and a part of the rows, so a hot key is in many tasks
        dealt = near.withColumn("_part", F.pmod(F.xxhash64("vec"), F.lit(16))).repartition("key", "_part").sortWithinPartitions("key")
        pieces, whole = dealt.drop("_part").mapInArrow(_joined_summer(settings, rank, columns), SUMS), None
    solved = pieces.select("id", "sums").repartition("id").sortWithinPartitions("id").mapInArrow(
        _solver(settings, rank), "id bigint, vec array<double>"
    )
    return settle(solved if whole is None else whole.unionByName(solved), "vectors")


def _miss(values: np.ndarray, marks: np.ndarray, dots: np.ndarray, settings: list[Setting], scale: tuple[float, float]) -> np.ndarray:
    """(count, squares, distances) of each setting over the rows it left out; values are what is left, then the bases, of each fold."""
    folds = values.shape[1] // 2
    out = np.zeros((len(settings), 3))
    for k, s in enumerate(settings):
        rows = np.flatnonzero(marks == s.fold)
        base = values[rows, folds + s.fold]
        miss = values[rows, s.fold] + base - np.clip(base + dots[rows, k], *scale)
        out[k] = len(rows), miss @ miss, np.abs(miss).sum()
    return out


def _miss_rows(out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(out), dtype=np.int32)), *(pa.array(out[:, i]) for i in range(3))], ["setting", "n", "squares", "distances"]
    )


def _misses(settings: list[Setting], rank: int, columns: int, lookup, scale: tuple[float, float]):
    """What each task's left-out ratings are missed by, for each setting."""

    def run(batches):
        out = np.zeros((len(settings), 3))
        for batch in batches:
            vectors_of, mine = lookup(), batch.column("vec")
            for k, (_, _, others, values, marks) in enumerate(_block_rows(batch, columns)):
                place, vectors = vectors_of(others)
                own = mine[k].values.to_numpy(zero_copy_only=False).reshape(len(settings), rank)
                dots = np.zeros((len(others), len(settings)))
                dots[place] = np.einsum("nsr,sr->ns", vectors.reshape(len(place), len(settings), rank), own)
                out += _miss(values, marks, dots, settings, scale)
        yield _miss_rows(out)

    return run


def _joined_misses(settings: list[Setting], rank: int, columns: int, scale: tuple[float, float]):
    """The same for rows that bring the vectors of both sides; an empty one counts as zeros."""

    def run(batches):
        out, width = np.zeros((len(settings), 3)), len(settings) * rank
        for batch in batches:
            mine, theirs = (_matrix(batch.column(c), width).reshape(-1, len(settings), rank) for c in ("vec", "other_vec"))
            dots = np.einsum("nsr,nsr->ns", mine, theirs)
            out += _miss(_matrix(batch.column("values"), columns), batch.column("fold").to_numpy(zero_copy_only=False), dots, settings, scale)
        yield _miss_rows(out)

    return run


def errors(
    ratings: DataFrame, own: DataFrame, held: DataFrame, rank: int, settings: list[Setting], columns: int,
    scale: tuple[float, float], sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """(setting, n, squares, distances) over the ratings that each setting left out.

    ``ratings`` are blocks whose values are, for each fold, what its biases leave
    and the bases. A side without a vector adds nothing to its base.
    """
    width = len(settings) * rank
    zeros = F.array_repeat(F.lit(0.0), width)
    schema = "setting int, n double, squares double, distances double"
    mine = own.select(F.col("id").alias("_own"), "vec")
    if held.count() * (width + 1) * 8 <= sent_bytes:
        lookup = _sent(held.select("id", "vec").toArrow(), width, held.sparkSession.sparkContext)
        rows = ratings.join(mine, F.col("key") == F.col("_own"), "left").withColumn("vec", F.coalesce("vec", zeros))
        told = rows.mapInArrow(_misses(settings, rank, columns, lookup, scale), schema)
    else:
        theirs = held.select("id", F.col("vec").alias("other_vec"))
        rows = settle(_entries(ratings, columns).join(mine, F.col("key") == F.col("_own"), "left").drop("_own", "key"), "own-vectors")
        rows = rows.join(theirs, "id", "left").withColumns({c: F.coalesce(c, zeros) for c in ("vec", "other_vec")})
        told = rows.mapInArrow(_joined_misses(settings, rank, columns, scale), schema)
    return told.groupBy("setting").agg(*(F.sum(c).alias(c) for c in ("n", "squares", "distances")))


def _entries(ratings: DataFrame, columns: int) -> DataFrame:
    """(key, id, fold, values): the ratings of blocks, one in a row."""
    values = F.transform(F.sequence(F.lit(0), F.size("others") - 1), lambda i: F.slice("values", i * columns + 1, F.lit(columns)))
    each = F.explode(F.arrays_zip("others", "folds", values.alias("values")))
    return ratings.select("key", each.alias("e")).select("key", F.col("e.others").alias("id"), F.col("e.folds").alias("fold"), "e.values")


def fit(ratings: DataFrame, rank: int, iterations: int, reg: float) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of users and of items for (userId, itemId, left): what biases leave of the ratings."""
    rows = settle(ratings.select("userId", "itemId", F.array("left").alias("values"), F.lit(0).alias("fold")), "left-ratings")
    by_user, by_item = blocks(rows, "userId", "itemId"), blocks(rows, "itemId", "userId")
    settings = [Setting(reg)]
    items = settle(first_vectors(by_item.select("key").distinct(), "key", rank), "first-vectors")
    users = None
    for _ in range(iterations):
        users = half_step(by_user, items, rank, settings)
        items = half_step(by_item, users, rank, settings)
    return users, items
