"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a sequence of first turns that some conversation begins with. It is
named by its smallest member and its depth, so the nodes of one member are a
chain, and the trie is a table of such chains.

Sums over subtrees are made without a walk from the leaves, which would take as
many rounds as the longest conversation has turns. In each component of the
parent-edge forest the deepest node with more than half of the component below it
is the centroid. What lies at or below it is added up, the total is added to every
node on the path from the centroid to the top, and the component splits into what
hangs below the centroid and what is left above. Each part has at most half of the
nodes, so after some 20 rounds all of 10^11 nodes lie in components of ``BOUND``
nodes, which are finished the same way inside tasks. Path and subtree are told by
a lookup of the ancestor at the centroid's depth, an equi-join with the table of
all members' nodes.

A conversation of any length is ordered by a range sort over all tasks. Each task
hashes its stretches, and stretches are joined by what the hash of a sequence and
its length tell. Turns are ordered by number, null first, then role and digest of
the text. Null roles and texts count as empty; rows without a conversation are left out;
repeated rows are turns of their own. No rows give no nodes. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.session import broadcast_if_small, settle

#: Nodes of a component that one task may hold.
BOUND = 1 << 13
#: Fixed values of the query: shared turns at most, and conversations that share them.
SHARED, BLOCK = 6, 100

_BASE = int(A.powers(2)[0][1])


def _power(exponents: np.ndarray) -> np.ndarray:
    """The base to each exponent modulo 2**64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(_BASE), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        left, square = left >> np.uint64(1), np.multiply(square, square)
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and hash of every first turn in this task's stretch of a conversation; rows come in order."""
    part, last, count, carry = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * 2
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = _column(batch, "conv_id")
        n = len(conv)
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        first = np.repeat(starts, np.diff(np.r_[starts, n]))
        place = np.arange(n) - first + 1
        goes_on = conv == last if last is not None else np.zeros(n, bool)
        up, down = (p[:n] for p in A.powers(n))
        lift = _power(place)
        hashes = []
        for k, name in enumerate(("t1", "t2")):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_column(batch, name).view(np.uint64) * down, out=total[1:])
            value = (total[1:] - total[first]) * up
            hashes.append(np.where(goes_on, value + carry[k] * lift, value))
        place = np.where(goes_on, place + count, place)
        last, count, carry = conv[-1], int(place[-1]), [h[-1] for h in hashes]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(place), *(pa.array(h.view(np.int64)) for h in hashes),
             batch.column("n_chars")],
            ["conv_id", "part", "place", "p1", "p2", "n_chars"],
        )


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of a sequence whose first part is exchanged: ``p`` plus (``to`` less ``off``) times the base to ``steps``."""
    for batch in batches:
        lift = _power(_column(batch, "steps"))
        made = []
        for k in "12":
            p, to, off = (_column(batch, name + k).view(np.uint64) for name in ("p", "to", "off"))
            made.append(pa.array((p + (to - off) * lift).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("depth"), *made, batch.column("n_chars")], ["conv_id", "depth", "p1", "p2", "n_chars"]
        )


_ROWS = "conv_id bigint, depth bigint, p1 bigint, p2 bigint, n_chars bigint"


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, n_chars``: each conversation's first ``depth`` turns, named by 128 bits."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        *(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(n) for at, n in ((1, "t1"), (17, "t2"))),
        F.char_length(text).cast("bigint").alias("n_chars"),
    )
    order = ["conv_id", "turn", "role", "t1", "t2"]
    stretches = settle(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "n_chars")
        .mapInArrow(_stretches, "conv_id bigint, part int, place bigint, p1 bigint, p2 bigint, n_chars bigint"), "stretches",
    )
    # only a conversation that goes over the end of a task has more than one, so these are two rows for each task at most
    ends = stretches.groupBy("conv_id", "part").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    ends = settle(ends, "stretch-ends")
    cut = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
    before, last = [], None
    for row in ends.join(cut, "conv_id", "left_semi").orderBy("conv_id", "part").collect():
        conv, part, end = row
        if last is None or last[0] != conv:
            last = (conv, 0, 0, 0)
        before.append((conv, part, *last[1:2], *(x - (1 << 64) if x >> 63 else x for x in last[2:])))
        lift = pow(_BASE, end["place"], 1 << 64)
        last = (conv, last[1] + end["place"], *((x * lift + y) % (1 << 64) for x, y in zip(last[2:], (end["p1"], end["p2"]))))
    if not before:
        return stretches.select("conv_id", F.col("place").alias("depth"), "p1", "p2", "n_chars")
    heads = spark.createDataFrame(before, "conv_id bigint, part int, begin bigint, to1 bigint, to2 bigint")
    zero = F.lit(0).cast("bigint")
    return stretches.join(F.broadcast(heads), ["conv_id", "part"], "left").select(
        "conv_id", (F.coalesce("begin", zero) + F.col("place")).alias("depth"), F.col("place").alias("steps"), "p1", "p2",
        *(F.coalesce(f"to{k}", zero).alias(f"to{k}") for k in (1, 2)), zero.alias("off1"), zero.alias("off2"), "n_chars",
    ).mapInArrow(_moved, _ROWS)


def rebuilt(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with first turns of another: ``(conv_id, depth, p1, p2, n_chars), (conv_id, length)``.

    The first h turns, h being the CRC-32 of the id's decimal digits modulo 6, are
    those of conversation c - c % 100, as far as it is there. The root is depth 0
    of every conversation.
    """
    early = F.when(F.col("depth") < SHARED, F.struct("depth", "p1", "p2", "n_chars"))  # a few turns each
    convs = settle(
        prefixes.groupBy("conv_id").agg(F.max("depth").alias("n"), F.array_sort(F.collect_list(early)).alias("first")), "conversations"
    )
    others = convs.select(F.col("conv_id").alias("home"), F.col("first").alias("theirs"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    zero = F.lit(0).cast("bigint")

    def name(turns: str, count: str, k: int):
        return F.when(F.size(turns) >= F.col(count), F.coalesce(F.get(F.col(turns), F.col(count) - 1)[f"p{k}"], zero)).otherwise(zero)

    plans = convs.withColumn("h", h).withColumn("home", F.col("conv_id") - F.col("conv_id") % BLOCK).join(others, "home", "left")
    plans = plans.withColumn("k", F.least("h", F.coalesce(F.size("theirs"), F.lit(0)))).select(
        "conv_id", "h", "k", "theirs", (F.col("k") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"),
        *(name("theirs", "k", k).alias(f"to{k}") for k in (1, 2)), *(name("first", "h", k).alias(f"off{k}") for k in (1, 2)),
    )
    plans = settle(plans, "plans")
    own = (
        prefixes.join(plans.drop("theirs"), "conv_id").where("depth > h")
        .select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), (F.col("depth") - F.col("h")).alias("steps"),
                "p1", "p2", "to1", "to2", "off1", "off2", "n_chars")
        .mapInArrow(_moved, _ROWS)
    )
    taken = plans.where("k > 0").select("conv_id", F.explode(F.slice("theirs", F.lit(1), F.col("k"))).alias("t")).select("conv_id", "t.*")
    roots = plans.select("conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2", "n_chars")))
    return own.unionByName(taken).unionByName(roots), plans.select("conv_id", "length")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, which come in order; a digest is fed row by row and holds none."""
    node, digest, made = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.string())],
            ["conv_id", "depth", "ends_sha256"],
        )

    for batch in batches:
        for owner, depth, member in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id"))):
            if node == (owner, depth):
                digest.update(b",%d" % member)
            else:
                if node:
                    made.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256(b"%d" % member)
        if len(made) >= 10_000:
            yield flush()
            made.clear()
    if node:
        made.append((*node, digest.hexdigest()))
        yield flush()


def trie(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the node of each member at each depth, both written.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, size, n_chars, ends_sha256`` with ``size`` the
    number of nodes in the subtree, and ``conv_id, depth, owner, parent``. A node's
    descendants are the chains of its members, so their lengths give its size.
    """
    rows = settle(rows, "prefixes")
    names = settle(
        rows.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars")),
        "prefix-names",
    )
    held = settle(rows.drop("n_chars").join(names, ["depth", "p1", "p2"]).select("conv_id", "depth", "owner", "n_convs", "n_chars"), "held")
    none = F.lit(None).cast("bigint")
    above = held.select("conv_id", (F.col("depth") + 1).alias("depth"), none.alias("owner"), none.alias("n_convs"), none.alias("n_chars"), F.col("owner").alias("parent"))
    paths = settle(
        held.withColumn("parent", none).unionByName(above).groupBy("conv_id", "depth")
        .agg(*(F.max(c).alias(c) for c in ("owner", "parent", "n_convs", "n_chars"))).where("owner IS NOT NULL"),
        "paths",
    )
    owned = held.groupBy("conv_id").agg(F.sum((F.col("owner") == F.col("conv_id")).cast("int")).alias("owned"))
    chains = settle(lengths.join(owned, "conv_id").select("conv_id", "length", "owned"), "chains")
    below = F.least(F.col("length") - F.col("depth") + 1, F.col("owned"))
    members = paths.select("conv_id", "depth", "owner").join(chains, "conv_id")
    sizes = members.groupBy("owner", "depth").agg(F.sum(below).alias("size"))
    ends = (
        members.where("depth = length").select("owner", "depth", "conv_id").repartition("owner", "depth")
        .sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(_end_digests, "conv_id bigint, depth bigint, ends_sha256 string")
    )
    children = paths.where("owner = conv_id AND depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = (
        paths.where("owner = conv_id").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_chars")
        .join(sizes.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"])
        .join(children, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    )
    empty = hashlib.sha256(b"").hexdigest()
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "ends_sha256": F.coalesce("ends_sha256", F.lit(empty))})
    return settle(nodes, "nodes"), paths.select("conv_id", "depth", "owner", "parent")


def component_sums(parents: list[int], sizes: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums over the subtrees of one component, by centroid decomposition.

    ``parents`` holds a place for each node, -1 for the top; ``sizes`` the nodes
    of each subtree, which is used up.
    """
    children: list[list[int]] = [[] for _ in parents]
    for node, parent in enumerate(parents):
        if parent >= 0:
            children[parent].append(node)
    out = [[0] * len(parents) for _ in values]
    cut = [False] * len(parents)
    tops = [node for node, parent in enumerate(parents) if parent < 0]
    while tops:
        top = tops.pop()
        half, centroid, path = sizes[top], top, []
        heavy: int | None = top
        while heavy is not None:
            centroid = heavy
            path.append(centroid)
            heavy = next((c for c in children[centroid] if not cut[c] and 2 * sizes[c] > half), None)
        path.pop()
        inside = [centroid]
        for node in inside:
            inside += [c for c in children[node] if not cut[c]]
        for sums, value in zip(out, values):
            total = sum([value[node] for node in inside])
            for node in path:
                sums[node] += total
            sums[centroid] += total
        for node in path:
            sizes[node] -= sizes[centroid]
        cut[centroid] = True
        tops += [c for c in children[centroid] if not cut[c]]
        if path:
            tops.append(top)
    return out


def _finish(names: tuple[str, ...]):
    """Sums of whole components, which come one behind the other, added to what the rows have."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close(rows: pa.Table) -> pa.RecordBatch:
            conv, depth, parent, size = (rows.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "size"))
            place = {node: k for k, node in enumerate(zip(conv, depth))}
            top = set(zip(rows.column("top").to_pylist(), rows.column("top_depth").to_pylist()))
            above = [-1 if (c, d) in top else place[(p, d - 1)] for c, d, p in zip(conv, depth, parent)]
            sums = component_sums(above, size, [rows.column(n).to_pylist() for n in names])
            made = [pa.array(np.array(s, np.int64) + _column(rows, f"sum_{n}")) for s, n in zip(sums, names)]
            return pa.RecordBatch.from_arrays([rows.column("conv_id").combine_chunks(), rows.column("depth").combine_chunks(), *made], ["conv_id", "depth", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            tops = np.stack([_column(batch, "top"), _column(batch, "top_depth")])
            change = np.flatnonzero((tops[:, 1:] != tops[:, :-1]).any(axis=0)) + 1
            if held:
                before = held[-1].slice(held[-1].num_rows - 1)
                if (_column(before, "top")[0], _column(before, "top_depth")[0]) != tuple(tops[:, 0]):
                    yield close(pa.Table.from_batches(held))
                    held = []
            if len(change):
                last = int(change[-1])
                yield close(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield close(pa.Table.from_batches(held))

    return run


def rollup(nodes: DataFrame, paths: DataFrame, values: tuple[str, ...], bound: int = BOUND) -> DataFrame:
    """``conv_id, depth`` and the sum of each of ``values`` over the node's subtree."""
    kinds = ", ".join(f"{v} bigint" for v in values)
    zero = F.lit(0).cast("bigint")
    root = nodes.where("depth = 0").select("conv_id").first()
    open_nodes = settle(
        nodes.select(
            "conv_id", "depth", "parent_conv_id", "size", *(F.col(v).cast("bigint").alias(v) for v in values),
            *(zero.alias(f"sum_{v}") for v in values), F.lit(root[0] if root else None).cast("bigint").alias("top"), zero.alias("top_depth"),
        ), "open-nodes",
    )
    component = ["top", "top_depth"]
    sums = [f"sum_{v}" for v in values]
    lookup = paths.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "depth", "owner", "parent")))
    small, done = [], []
    while True:
        totals = settle(open_nodes.groupBy(*component).agg(F.max("size").alias("total")), "component-sizes")
        large = totals.where(F.col("total") > bound)
        if not large.take(1):
            small.append(open_nodes)
            break
        large = broadcast_if_small(settle(large, "large-components"), 64)
        small.append(open_nodes.join(large, component, "left_anti"))
        within = open_nodes.join(large, component)
        # nodes with more than half below them are one line, the centroid is its end
        heavy = within.where(2 * F.col("size") > F.col("total")).groupBy(*component).agg(F.max(F.struct("depth", "conv_id", "size")).alias("c"))
        centroids = settle(heavy.select(*component, F.col("c.depth").alias("c_depth"), F.col("c.conv_id").alias("c_conv"), F.col("c.size").alias("c_size")), "centroids")
        asked = open_nodes.join(broadcast_if_small(centroids, 64), component)
        deep = F.col("depth") > F.col("c_depth")
        asked = asked.withColumns({
            "_at": F.when(deep, F.col("conv_id")).otherwise(F.col("c_conv")), "_of": F.when(deep, F.col("c_depth") + 1).otherwise(F.col("depth")),
        })
        known = asked.join(lookup, (F.col("_at") == F.col("_conv_id")) & (F.col("_of") == F.col("_depth")))
        told = settle(
            known.withColumns({
                "below": deep & (F.col("_parent") == F.col("c_conv")),
                "above": ~deep & (F.col("_owner") == F.col("conv_id")),
                "centre": (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv")),
            }).drop("_at", "_of", "_conv_id", "_depth", "_parent"), "told-nodes",
        )
        # the part at and below the centroid, added to every node on the way up
        parts = settle(
            told.where("below OR centre").groupBy(*component).agg(*(F.sum(v).alias(f"part_{v}") for v in values)), "component-totals"
        )
        added = told.join(broadcast_if_small(parts, 64), component)
        added = added.withColumns(
            {f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("above"), F.col(f"part_{v}")).otherwise(0) for v in values}
            | {"size": F.col("size") - F.when(F.col("above") & ~F.col("centre"), F.col("c_size")).otherwise(0)}
            | {"top": F.when(F.col("below"), F.col("_owner")).otherwise(F.col("top")),
               "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))}
        ).select(*open_nodes.columns, "centre")
        added = settle(added, "split-nodes")
        done.append(added.where("centre").select("conv_id", "depth", *(F.col(s).alias(v) for s, v in zip(sums, values))))
        open_nodes = added.where("NOT centre").drop("centre")
    parts = None
    for table in small:
        parts = table if parts is None else parts.unionByName(table)
    out = parts.repartition(*component).sortWithinPartitions(*component).mapInArrow(
        _finish(values), f"conv_id bigint, depth bigint, {kinds}"
    )
    for table in done:
        out = out.unionByName(table)
    return out


def prefix_trie(rows: DataFrame, lengths: DataFrame, bound: int = BOUND) -> DataFrame:
    """All nodes with their members, children, and the leaves and saved text of their subtrees."""
    nodes, paths = trie(rows, lengths)
    valued = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("n_chars")})
    sums = rollup(valued, paths, ("leaf", "saved"), bound)
    return nodes.join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    rows, lengths = rebuilt(turn_prefixes(spark.read.parquet(f"{folder}/conversations.parquet")))
    return prefix_trie(rows, lengths)


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(role || chr(1) || text ORDER BY place) AS turns FROM turns GROUP BY conv_id
), shared AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda x, step: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM own
), whole AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns
  FROM shared s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100
), held AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) AS length, turns[d] AS final
  FROM whole, unnest(range(len(turns) + 1)) AS u(d)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE max(length(final) - instr(final, chr(1))) END AS n_chars,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
  FROM held GROUP BY prefix, depth
), kids AS (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), valued AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix, depth)
), sums AS (
  SELECT n.prefix[1:d] AS prefix, d AS depth, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.n_chars) AS saved_tokens
  FROM valued n, unnest(range(n.depth + 1)) AS u(d) GROUP BY 1, 2
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN sums s USING (prefix, depth) LEFT JOIN nodes p ON p.prefix = v.prefix[1:v.depth - 1] AND p.depth = v.depth - 1
"""
