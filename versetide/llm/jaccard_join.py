"""Size-aware heavy-light join of documents on their word shingles.

Light (small) sets list their subsets of each size that a partner can share.
Heavy (large) sets are met through inverted lists. A list of one single common
shingle would have no bound, so lists are kept for blocks of a set: two sets
that differ in fewer shingles than there are blocks have an equal block. Every
set is light or heavy by the number of keys and elements either way would cost.

Lists are sorted rows, dealt by range, so that none has to fit in one task. In
a list every member is compared with one hub; only members that stay in another
component than others of the same hub are compared with each other, in blocks,
by their differences from the hub.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.llm.graph import components
from versetide.session import broadcast_if_small, settle

WIDTH = 4
#: Least similarity, in hundredths.
LEAST = 85
#: Ratio of the bounds of a size class.
STEP = 1.3
#: Elements of a block that is listed; a single common shingle makes no list.
BLOCK = 2
#: Members of a hub that one task compares with as many others.
CHUNK = 500
#: Sorted key rows for each partition.
LIST_ROWS = 2_000_000
#: Seeds that a set tries until few of its blocks are too small to list.
SEEDS = 16


def most_apart(total: int, least: int = LEAST) -> int:
    """Largest symmetric difference of two linked sets with ``total`` elements together."""
    return total * (100 - least) // (100 + least)


class Plan:
    """Which keys a set of a given size needs. A few numbers for each size class."""

    def __init__(self, least: int = LEAST):
        self.least = least
        light = 2
        while self.subsets(light) <= 2 * most_apart(2 * light, least) + light + 2:
            light += 1
        self.light = light
        uppers = [light]
        while uppers[-1] < 1 << 40:
            uppers.append(math.ceil(uppers[-1] * STEP))
        self.uppers = np.array(uppers)

    def missing(self, n: int) -> int:
        """Elements of a set of ``n`` that a partner may lack."""
        return n - -(-n * self.least // 100)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, t) for t in range(self.missing(n) + 1))

    def classes(self, n: int) -> list[int]:
        """Size classes whose blocks a set needs: its own up to that of its largest partner."""
        own = int(np.searchsorted(self.uppers, n, "right"))
        other = int(np.searchsorted(self.uppers, n * 100 // self.least, "right"))
        return [c for c in range(own, other + 1) if c > 0]

    def blocks(self, c: int) -> int:
        """Number of blocks of a size class: more than two linked sets of it can be apart."""
        apart = most_apart(2 * (int(self.uppers[c]) - 1), self.least)
        return apart + 1 + max(1, apart // 7)

    def spare(self, n: int, c: int) -> int:
        """How many blocks of a set of ``n`` may be too small to list.

        Counted from its own largest partner in the class. With what the largest sets
        of the class may be apart, most sets would fail with every seed at a low
        ``least`` and meet in one list.
        """
        partner = min(int(self.uppers[c]) - 1, n * 100 // self.least)
        return self.blocks(c) - 1 - most_apart(n + partner, self.least)


def _subset_keys(x: np.ndarray, missing: int) -> np.ndarray:
    """Hash of each subset that lacks at most ``missing`` elements (a sum, so order is free)."""
    values = A.mix(x)
    total = values.sum(dtype=np.uint64, keepdims=True)
    out = []
    for t in range(missing + 1):
        gone = np.array(list(itertools.combinations(range(len(x)), t)), int).reshape(math.comb(len(x), t), t)
        out.append(total - values[gone].sum(axis=1, dtype=np.uint64) + np.uint64(len(x) - t))
    return np.concatenate(out)


def set_keys(x: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys of the set ``x``; two sets that are linked and differ share one."""
    n, keys = len(x), []
    if n < 2:
        return np.zeros(0, np.uint64)
    if n < plan.light:
        if plan.missing(n) or (n * 100) >= plan.least * (n + 1):  # else no larger partner either
            keys.append(_subset_keys(x, plan.missing(n)))
    for c in plan.classes(n):
        count, spare = plan.blocks(c), plan.spare(n, c)
        for seed in range(SEEDS):
            block = (A.mix(x + np.uint64(seed + 1)) >> np.uint64(33)) % np.uint64(count)
            order = np.argsort(block, kind="stable")
            block = block[order]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(A.mix(x[order]), out=total[1:])
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            last = np.r_[first[1:], n]
            listed = last - first >= BLOCK
            first, last = first[listed], last[listed]
            name = A.mix(block[first] + np.uint64(((c << 8) + seed) << 40))
            keys.append(A.mix(total[last] - total[first] + name))
            if count - len(first) <= spare:
                break  # enough blocks are listed: any partner shares a listed one
        else:
            keys.append(np.array([(c << 8) + 255], np.uint64))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def shingle_sets(batch: pa.RecordBatch, text: str, width: int = WIDTH) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of ``batch``: the rows, their sorted distinct shingles one after the other, and bounds."""
    for part in A.slices(batch, text):
        data, bounds = A.raw(part.column(text))
        _, _, rows, hashes = A.word_hashes(data, bounds)
        grams, inside = A.gram_hashes(hashes, width), A.whole(rows, width)
        grams, owner = grams[inside], rows[: len(inside)][inside]
        size = np.bincount(rows, minlength=len(part))
        few = np.flatnonzero((size > 0) & (size < width))  # the whole sequence is the only shingle
        start = np.searchsorted(rows, few)
        short = [A.gram_hashes(hashes[s : s + size[r]], size[r])[0] + np.uint64(size[r]) for r, s in zip(few, start)]
        grams, owner = np.r_[grams, np.array(short, np.uint64)], np.r_[owner, few]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield part, grams, np.searchsorted(owner, np.arange(len(part) + 1))


def _set_name(x: np.ndarray) -> int:
    return int((A.mix(A.mix(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))) | np.uint64(1)).view(np.int64)[0])


def _signer(key: str, text: str, least: int, width: int):
    def sign(batches):
        plan = Plan(least)
        for batch in batches:
            for part, grams, bounds in shingle_sets(batch, text, width):
                sizes = np.diff(bounds)
                names, keys = [], []
                for i, n in enumerate(sizes):
                    x = grams[bounds[i] : bounds[i + 1]]
                    names.append(_set_name(x) if n else None)
                    keys.append(set_keys(x, plan))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                     A.lists(A.signed(flat), np.array([len(k) for k in keys], np.int64), pa.int64())],
                    ["_key", "n", "set", "keys"],
                )

    return sign


def _setter(text: str, width: int):
    def sets(batches):
        for batch in batches:
            for part, grams, bounds in shingle_sets(batch, text, width):
                sizes = np.diff(bounds)
                names = pa.array([_set_name(grams[bounds[i] : bounds[i + 1]]) if n else None for i, n in enumerate(sizes)], pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [names, part.column("hubs"), A.lists(A.signed(grams), sizes, pa.int64())], ["set", "hubs", "items"]
                )
                yield out.filter(pc.fill_null(pc.equal(names, part.column("wanted")), False))

    return sets


def _long_lists(batches):
    """Of rows sorted by key, those that have a neighbour of the same key.

    The first and last row of a partition always stay, as their neighbour may be
    in the next one.
    """
    held, alike = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        same = np.r_[alike, key[1:] == key[:-1]]
        yield batch.slice(0, len(key) - 1).filter(pa.array(same[:-1] | same[1:]))
        held, alike = batch.slice(len(key) - 1), bool(same[-1])
    if held is not None:
        yield held


def _differ(batches):
    """Of each pair of sets, the elements that only one of them has."""
    for batch in batches:
        mine, theirs = batch.column("items"), batch.column("hub_items")
        (a, ab), (b, bb) = _flat(mine), _flat(theirs)
        out = [np.setxor1d(a[ab[i] : ab[i + 1]], b[bb[i] : bb[i + 1]], assume_unique=True) for i in range(batch.num_rows)]
        sizes = np.array([len(x) for x in out], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("hub"), batch.column("member"), pa.array(np.diff(ab), pa.int64()),
             pa.array(np.diff(bb), pa.int64()), A.lists(np.concatenate(out) if out else np.zeros(0, np.int64), sizes, pa.int64())],
            ["hub", "member", "n", "hub_n", "apart"],
        )


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def _compare(least: int):
    def compare(table: pa.Table) -> pa.Table:
        """Links between members of two chunks of one hub that are in different components.

        Two sets differ in |D| + |E| - 2 |D and E| elements, D and E being what
        each has apart from the hub.
        """
        table = table.combine_chunks()
        part = table.column("chunk").to_numpy()
        n, root = table.column("n").to_numpy(), table.column("root").to_numpy()
        member = table.column("member").to_numpy()
        column = table.column("apart")
        flat, bounds = _flat(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        size = np.diff(bounds)
        i, j = part.min(), part.max()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        right = right[np.argsort(size[right], kind="stable")]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(right):
            flat_right = np.concatenate([flat[bounds[r] : bounds[r + 1]] for r in right])
            at = np.r_[0, np.cumsum(size[right])]
            for x in left:
                mine = flat[bounds[x] : bounds[x + 1]]
                # |E| differs from |D| by at most the largest difference with any size in the chunk
                reach = (n[x] + n[right].max()) * (100 - least) // (100 + least)
                lo = np.searchsorted(size[right], size[x] - reach)
                hi = np.searchsorted(size[right], size[x] + reach, "right")
                if lo == hi:
                    continue
                near = right[lo:hi]
                theirs = flat_right[at[lo] : at[hi]]
                common = np.zeros(len(near), np.int64)
                if len(mine) and len(theirs):
                    spot = np.searchsorted(mine, theirs)
                    spot[spot == len(mine)] = 0
                    hits = np.r_[0, np.cumsum(mine[spot] == theirs)]
                    common = hits[at[lo + 1 : hi + 1] - at[lo]] - hits[at[lo:hi] - at[lo]]
                apart = size[x] + size[near] - 2 * common
                linked = (apart * (100 + least) <= (n[x] + n[near]) * (100 - least)) & (root[near] != root[x])
                for y in near[linked]:
                    found.setdefault((min(root[x], root[y]), max(root[x], root[y])), (member[x], member[y]))
        pairs = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return compare


def jaccard_components(
    documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, width: int = WIDTH
) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``documents``.

    Words are A-Z lower-cased runs without white space; a set is the distinct
    runs of ``width`` words, or the whole sequence of fewer. Rows whose sets overlap
    by ``least`` hundredths of their union are linked; ``component_id`` is the
    smallest key reachable. Null and empty texts have no shingles and are linked
    with nothing, so they stand alone with their own key. Rows with equal sets
    are one class from the start, so repeated rows cost nothing and share a
    component. Other columns are ignored. Shingles and sets are told apart by
    64-bit hashes.
    """
    source = documents.select(key, text)
    signed = settle(
        source.mapInArrow(
            _signer(key, text, least, width),
            f"_key {source.schema[key].dataType.simpleString()}, n long, `set` long, keys array<long>",
        ),
        "signed",
    )
    # one row stands for all equal sets; `rows` counts how often that very row is there
    classes = settle(
        signed.where("n > 1").groupBy("set", "_key").agg(F.count("*").alias("rows"))
        .groupBy("set").agg(F.min(F.struct("_key", "rows")).alias("low")).select("set", "low.*"),
        "classes",
    )
    mark = classes.select(F.col("set").alias("_set"), F.col("_key").alias("_first"))
    chosen = signed.join(
        broadcast_if_small(mark, 16),
        (F.col("set") == F.col("_set")) & F.col("_key").eqNullSafe(F.col("_first")), "left_semi",
    )
    rows = chosen.select(F.explode("keys").alias("key"), "set")
    count = max(1, -(-(chosen.agg(F.sum(F.size("keys"))).first()[0] or 0) // LIST_ROWS), _parallel(signed))
    lists = settle(
        rows.repartitionByRange(count, "key", "set").sortWithinPartitions("key", "set")
        .mapInArrow(_long_lists, "key long, `set` long").distinct(),
        "lists",
    )
    # the hub of a list is the member that meets most others
    length = lists.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    met = lists.join(length, "key")
    score = met.groupBy("set").agg(F.sum("length").alias("score"))
    hubs = met.join(score, "set").groupBy("key").agg(F.max(F.struct("score", "set")).alias("hub"))
    stars = settle(
        lists.join(hubs, "key").select(F.col("hub.set").alias("hub"), F.col("set").alias("member"))
        .where("hub <> member").distinct(),
        "hub-members",
    )
    # each set goes to the hubs it is compared with, a hub's own set to itself
    pairs = stars.select(F.col("member").alias("set"), "hub").unionByName(
        stars.select(F.col("hub").alias("set"), "hub").distinct()
    )
    wanted = settle(
        pairs.groupBy("set").agg(F.collect_set("hub").alias("hubs")).join(classes, "set")
        .select(F.col("set").alias("wanted"), F.col("_key").alias("_wanted_key"), "hubs", "rows"),
        "wanted",
    )

    def sent(rows: DataFrame) -> DataFrame:
        return (
            source.join(broadcast_if_small(rows, 64), F.col(key).eqNullSafe(F.col("_wanted_key")))
            .select(text, "wanted", "hubs").mapInArrow(_setter(text, width), "`set` long, hubs array<long>, items array<long>")
        )

    sets = sent(wanted.where("rows = 1"))
    if wanted.where("rows > 1").take(1):
        sets = sets.unionByName(sent(wanted.where("rows > 1")).dropDuplicates(["set"]))
    sets = sets.withColumn("hub", F.explode("hubs")).drop("hubs")
    differ = settle(
        sets.where("set <> hub").select("hub", F.col("set").alias("member"), "items")
        .join(sets.where("set = hub").select("hub", F.col("items").alias("hub_items")), "hub")
        .mapInArrow(_differ, "hub long, member long, n long, hub_n long, apart array<long>"),
        "apart",
    )
    near = differ.where((100 + least) * F.size("apart") <= (100 - least) * (F.col("n") + F.col("hub_n")))
    first = settle(components(near.select("hub", "member"), "hub", "member"), "first-roots")

    # the hub itself counts as a member that has nothing apart
    self_row = differ.groupBy("hub").agg(F.first("hub_n").alias("n")).select(
        "hub", F.col("hub").alias("member"), "n", F.array().cast("array<bigint>").alias("apart")
    )
    members = differ.select("hub", "member", "n", "apart").unionByName(self_row)
    rooted = settle(
        members.join(first.withColumnRenamed("node", "member"), "member", "left")
        .withColumn("root", F.coalesce("root", "member")),
        "rooted",
    )
    open_hubs = rooted.groupBy("hub").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low < high AND size > 2")  # two are the hub and one that was compared with it
    dealt = rooted.join(open_hubs.select("hub", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "hub").withColumn(
        "chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")
    )
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "hub", "member", "n", "apart", "root", "chunk",
        F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"),
    )
    more = paired.groupBy("hub", "i", "j").applyInArrow(_compare(least), "u long, v long")
    roots = settle(
        components(near.select(F.col("hub").alias("u"), F.col("member").alias("v")).unionByName(more), "u", "v"), "roots"
    )
    placed = signed.select("_key", "n", "set").join(
        roots.withColumnRenamed("node", "set"), "set", "left"
    ).withColumn("root", F.coalesce("root", "set"))
    least_key = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("_key").alias("component_id"))
    return placed.join(least_key, "root", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "_key").alias("component_id"),
    )


def _parallel(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document."""
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"))
