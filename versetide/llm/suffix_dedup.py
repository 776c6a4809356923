"""Removal of repeated byte strings by prefix doubling over sampled positions.

Ranking every byte position of a corpus takes many times its size, so the rounds
run over synchronising positions: in each window of LENGTH bytes the position whose
PREFIX-byte hash is smallest. Equal windows choose alike, so no repeat is lost, and
neighbouring positions are at most PREFIX apart, so a chain of them covers every byte.

1. Positions are sorted by the rank of their PREFIX bytes. One that is in one
   document only is closed: all windows that chose it are unique.
2. Rounds: the rank of each open position is paired with its distance to, and the rank
   of, the last open position that its bytes reach, which about doubles the bytes that it
   stands for. The pairs are sorted, and a rank in one document only is closed. Rounds go
   on until all are closed or past LENGTH and past the windows of the positions they begin for.
3. The rank of the position before a stretch of windows then names the way in which
   its prefix goes on. Of equal ways all but those of the smallest document are repeats as
   a whole. Where one prefix goes on in several ways, single windows decide: one stretch of
   each way is ranked window by window by all LENGTH bytes, past which nothing
   has to be told apart.

Rows are dealt by rank. Ranks that a sample shows to be common (HOT of them at
most) are dealt by document as well, so a string that a third of all documents
hold is spread over tasks; what is first in each part is then compared apart.
There is a row for every 13 bytes, so a task packs the rows of one bucket of ranks, or
of texts, into one block: Spark moves blocks, and the rows of a bucket, SORT_ROWS
about, are sorted inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.session import broadcast_if_small, emptied, settle

LENGTH = 50
#: Not below (LENGTH + 1) / 2, so that neighbouring positions touch.
PREFIX = 26
#: Rows of one rank and document that are held until another document shows up; more count as open.
HELD = 1 << 16
#: Rows for each partition, which is one bucket. They reach a task as one Arrow batch.
SORT_ROWS = 400_000
#: Rows that a task packs at once.
PACKED = 1 << 18
#: A rank with more than one in HOT of the rows of a sample is spread over SPREAD parts.
#: The sample is of documents, by hash of the key: SAMPLE of them, about. It decides where rows go
#: and nothing else.
HOT, SPREAD, SAMPLE = 2000, 64, 10_000
#: Bytes of a text that are ranked at once; a longer text is taken in overlapping pieces.
PIECE = 1 << 22

SPAN = "struct<start:bigint,stop:bigint>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_LOW = np.uint64((1 << 23) - 1)  # more than PIECE


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    done = 1
    out = values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - done : width - done + n])


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, prefix: int = PREFIX):
    """Runs of windows that choose the same position.

    Returns the first and last window of each, the row, the position, its prefix's
    hash, and the running sums of the bytes.
    """
    total = A.sums(A.BYTE[data])
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), total
    name = (total[prefix:] - total[:-prefix]) * A.powers(len(data) + 1)[1][: len(data) - prefix + 1]
    order = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order &= ~_LOW
    order |= np.arange(len(name), dtype=np.uint64)
    chosen = (_window_min(order, length - prefix + 1) & _LOW).view(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    # windows that leave their row are none; those around them begin a run of their own
    edge = bounds[1:-1]
    new[edge[edge < len(chosen)]] = True
    within = np.ones(len(chosen), bool)
    for back in range(1, length):
        at = edge - back
        within[at[(at >= 0) & (at < len(chosen))]] = False
    at = np.flatnonzero(new & within)
    # a run ends before the next one begins, or before the windows that leave the row
    stop = np.flatnonzero(new | ~within)
    following = np.searchsorted(stop, at, "right")
    last = np.r_[stop, len(chosen)][following] - 1
    row = np.searchsorted(bounds, at, "right") - 1
    return at, last, row, chosen[at], A.mix(name[chosen[at]]), total


def _pieces(part: pa.RecordBatch, text: str, length: int):
    """``(data, bounds, rows, start)``: the slice, or overlapping pieces of its one long text.

    Every window of ``length`` bytes lies in a piece. The runs at a piece's end are cut short;
    so that equal texts are cut alike, pieces begin at fixed places of the text.
    """
    data, bounds = A.raw(part.column(text))
    if len(data) <= PIECE:
        yield data, bounds, 0
        return
    for start in range(0, max(1, len(data) - length + 1), PIECE - 2 * length):
        piece = data[start : start + PIECE]
        yield piece, np.array([0, len(piece)]), start


def _packed(start, first, last, row, at, bounds) -> np.ndarray:
    """Place in the text, bytes of the stretch before it and from it on, in one number."""
    return (start + at - bounds[row]) << 12 | (at - first) << 6 | (last + LENGTH - at)


def _positions(text: str):
    """The chosen positions of each text, and its first and last PREFIX bytes, for which no window stands."""

    def positions(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                doc, number = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_h1"))
                for data, bounds, start in _pieces(part, text, LENGTH):
                    first, last, row, at, name, total = stretches(data, bounds)
                    long = np.flatnonzero(np.diff(bounds) >= LENGTH)
                    ends = np.r_[bounds[:-1][long], bounds[1:][long] - PREFIX]
                    of = np.r_[long, long]
                    rank = np.r_[name, A.spans_hash(total, ends, ends + PREFIX)]
                    place = np.r_[_packed(start, first, last, row, at, bounds), (start + ends - bounds[of]) << 12]
                    row = np.r_[row, of]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(A.signed(rank)), pa.array(doc[row], pa.int64()), pa.array(number[row], pa.int64()), pa.array(place, pa.int64())],
                        ["rank", "doc", "row", "at"],
                    )

    return positions


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _taken(rows: dict, which) -> dict:
    return {c: x[which] for c, x in rows.items()}


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], list(rows))


#: Kinds of blocks and their columns, all 64-bit: positions, positions in rounds (``bits``: cover and state),
#: open ones of these by rank, stretches and their ways, single windows, windows by document.
POSITION, PLACED, RANKED, STRETCH, WINDOW, GONE = 10, 11, 12, 13, 14, 15
#: What comes of a rank's rows: see _rerank.
REPEAT, APART, EDGE = 0, 1, 2
_STATE = ("doc", "row", "at", "name", "rank", "bits")
_COLUMNS = {
    POSITION: ("rank", "doc", "row", "at"), PLACED: _STATE, RANKED: _STATE, STRETCH: ("rank", "longer", "doc", "row", "at"),
    WINDOW: ("rank", "doc"), GONE: ("doc", "rank"), REPEAT: ("doc", "row", "at"), APART: ("doc", "row", "at"),
}
_BLOCKS = "kind int, bucket int, n long, block binary"


def _pack(stream, buckets: int):
    """Blocks of the ``(kind, rows, key)`` of a task: the rows of one bucket of keys, column by column."""
    held: dict[int, list[dict]] = {}
    many = 0
    for kind, rows, key in stream:
        held.setdefault(kind, []).append({**{c: rows[c] for c in _COLUMNS[kind]}, "": (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)})
        many += len(key)
        if many >= PACKED:
            yield from _blocks(held)
            held, many = {}, 0
    yield from _blocks(held)


def _blocks(held: dict[int, list[dict]]):
    for kind, parts in held.items():
        bucket = np.concatenate([x[""] for x in parts])
        if not len(bucket):
            continue
        order = np.argsort(bucket, kind="stable")
        bucket, start, many = np.unique(bucket[order], return_index=True, return_counts=True)
        names = _COLUMNS[kind]
        to = np.arange(len(order)) + np.repeat((len(names) - 1) * start, many)
        step = np.repeat(many, many)
        block = np.empty(len(names) * len(order), np.int64)
        for c in names:
            block[to] = np.concatenate([x[c] for x in parts])[order]
            to += step
        offsets = np.r_[start, len(order)] * (8 * len(names))
        blocks = pa.Array.from_buffers(pa.large_binary(), len(bucket), [None, pa.py_buffer(offsets), pa.py_buffer(block)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(bucket), kind, np.int32)), pa.array(bucket), pa.array(many), blocks.cast(pa.binary())],
            ["kind", "bucket", "n", "block"],
        )


def _unpack(batches):
    """``{kind: rows}`` of each bucket, from blocks in the order of their buckets."""
    held: dict[int, list[np.ndarray]] = {}
    of = None
    for batch in batches:
        for kind, bucket, block in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("block")):
            if held and bucket != of:
                yield _rows(held)
                held = {}
            of = bucket
            held.setdefault(kind, []).append(np.frombuffer(block.as_buffer(), np.int64).reshape(len(_COLUMNS[kind]), -1))
    if held:
        yield _rows(held)


def _rows(held: dict[int, list[np.ndarray]]) -> dict[int, dict]:
    return {kind: dict(zip(_COLUMNS[kind], np.concatenate(blocks, axis=1))) for kind, blocks in held.items()}


def _sorted(rows: dict, *names: str) -> dict:
    return _taken(rows, np.lexsort([rows[c] for c in reversed(names)]))


def _is_hot(rank: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which ranks are among the common ones, which are sorted."""
    if not len(hot):
        return np.zeros(len(rank), bool)
    return hot[np.minimum(np.searchsorted(hot, rank), len(hot) - 1)] == rank


def _rank_key(rank: np.ndarray, hot: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a rank's rows go: common ranks are dealt by document too."""
    part = np.where(hot, _named(doc).view(np.uint64) % np.uint64(SPREAD) + np.uint64(1), np.uint64(0))
    return _named(rank, part)


def _met(rows: dict, hot: np.ndarray) -> dict:
    """Rows of a bucket by rank and document, without ranks that are there once and not common."""
    rows = _taken(rows, np.argsort(rows["rank"]))
    same = rows["rank"][1:] == rows["rank"][:-1]
    rows["hot"] = _is_hot(rows["rank"], hot)
    return _sorted(_taken(rows, rows["hot"] | np.r_[same, False] | np.r_[False, same]), "rank", "doc")


#: States of a position: to be paired, past all it stands for, in one document only, without a next one.
OPEN, PAST, UNIQUE, LAST = 0, 1, 2, 3


def _shared(batches):
    """One pass over rows sorted by rank and document: ``(rows, several)``, whether the rank is in several documents.

    Common ranks always count as such, as their rows are in several parts.
    """
    held, known = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _arrays(batch)
        rows = rows if held is None else _joined([held, rows])
        rank, doc = rows["rank"], rows["doc"]
        start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        size = np.diff(np.r_[start, len(rank)])
        several = (doc[start] != doc[start + size - 1]) | rows["hot"][start]
        several[0] |= known is not None and rank[0] == known
        whole = len(rank)
        if not several[-1] and size[-1] <= HELD:
            whole = start[-1]
        else:
            several[-1], known = True, rank[-1]
        held = _taken(rows, slice(whole, None)) if whole < len(rank) else None
        if whole:
            yield _taken(rows, slice(0, whole)), np.repeat(several, size)[:whole]
    if held is not None:
        yield held, np.zeros(len(held["rank"]), bool)


def _opener(hot: np.ndarray, buckets: int):
    """Positions of which the prefix is in several documents, by text."""

    def stream(batches):
        for parts in _unpack(batches):
            for rows, several in _shared([_batch(_met(parts[POSITION], hot))]):
                rows = _taken(rows, several)
                yield POSITION, rows, _named(rows["doc"], rows["row"])

    return lambda batches: _pack(stream(batches), buckets)


def _closer(hot: np.ndarray, buckets: int):
    """One sort of pairs: those in one document only are closed."""

    def stream(batches):
        for parts in _unpack(batches):
            rows = _sorted(parts[RANKED], "rank", "doc")
            for rows, several in _shared([_batch({**rows, "hot": _is_hot(rows["name"], hot)})]):
                rows["bits"] = np.where(several, rows["bits"], rows["bits"] & ~3 | UNIQUE)
                yield PLACED, rows, _named(rows["doc"], rows["row"])

    return lambda batches: _pack(stream(batches), buckets)


def _by_text(batches):
    """Rows sorted by document and text, in runs of whole texts."""
    parts: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _arrays(batch)
        new = np.flatnonzero(np.r_[
            not parts or rows["doc"][0] != parts[-1]["doc"][-1] or rows["row"][0] != parts[-1]["row"][-1],
            (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1]),
        ])
        if not len(new):
            parts.append(rows)
            continue
        if new[-1] or parts:
            yield _joined([*parts, _taken(rows, slice(0, new[-1]))])
        parts = [_taken(rows, slice(new[-1], None))]
    if parts:
        yield _joined(parts)


def _named(*values) -> np.ndarray:
    out = np.uint64(len(values))
    for value in values:
        out = A.mix((out + value.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return A.signed(out)


def _texts(batches):
    """Positions in rounds, in runs of whole texts."""
    for parts in _unpack(batches):
        rows = [parts[PLACED]] if PLACED in parts else []
        if POSITION in parts:
            first = parts[POSITION]
            rows.append({**first, "name": first["rank"], "bits": np.full(len(first["rank"]), PREFIX << 2 | OPEN)})
        yield from _by_text([_batch(_sorted(_joined([{c: x[c] for c in _STATE} for x in rows]), "doc", "row", "at"))])


def _layout(rows: dict):
    """Places that tell texts apart, the position that stands for each stretch, whether there is one, and how far it has to reach."""
    doc, row, at = rows["doc"], rows["row"], rows["at"]
    text = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    place = at >> 12
    place = place + text * (place.max() + (rows["bits"] >> 2).max() + 2 * LENGTH)
    before, after = (at >> 6) & 63, at & 63
    # the last position at or before a stretch stands for all of it
    base = np.searchsorted(place, place - before, "right") - 1
    own = (after > 0) & (base >= 0) & (text[base] == text)
    return place, base, own, place + after - place[base]


def _pair(rows: dict) -> dict:
    """One round: (rank, distance, rank of the last position reached)."""
    place, base, own, reach = _layout(rows)
    rank, cover, state = rows["rank"], rows["bits"] >> 2, rows["bits"] & 3
    need = np.full(len(place), LENGTH)
    np.maximum.at(need, base[own], reach[own])

    next_ = np.searchsorted(place, place + cover, "right") - 1
    distance = place[next_] - place
    grown = distance + cover[next_]
    todo = state == OPEN
    unique = todo & (state[next_] == UNIQUE)
    last = todo & ~unique & (grown <= cover)
    longer = todo & ~unique & ~last
    rank = np.where(longer, _named(rank, distance, rank[next_]), rank)
    cover = np.where(longer, grown, cover)
    state = np.select([unique, last, longer & (cover >= need)], [UNIQUE, LAST, PAST], state)
    return {**rows, "rank": rank, "bits": cover << 2 | state}


def _pairer(hot: np.ndarray, buckets: int):
    def stream(batches):
        for rows in _texts(batches):
            rows = _pair(rows)
            open_ = rows["bits"] & 3 == OPEN
            done, rows = _taken(rows, ~open_), _taken(rows, open_)
            yield PLACED, done, _named(done["doc"], done["row"])
            yield RANKED, rows, _rank_key(rows["rank"], _is_hot(rows["name"], hot), rows["doc"])

    return lambda batches: _pack(stream(batches), buckets)


def _stretches(batches):
    """``rank, longer, doc, row, at`` of each stretch: its prefix, and the way in which that goes on."""
    for rows in _texts(batches):
        place, base, own, reach = _layout(rows)
        known = own & (rows["bits"][base] & 3 != UNIQUE) & (rows["bits"][base] >> 2 >= reach)
        doc, row, at = rows["doc"], rows["row"], rows["at"]
        way = np.where(known, _named(rows["rank"][base], place - place[base], at & 4095), _named(doc, row, at))
        yield _taken({"rank": rows["name"], "longer": way, "doc": doc, "row": row, "at": at}, at & 63 > 0)


def _parts(rows: DataFrame, expected: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-expected // SORT_ROWS))


def _by_bucket(blocks: DataFrame, expected: int) -> DataFrame:
    """Blocks of one bucket, or of the same few, in each partition; a hash of the buckets would fill some many times over."""
    parts = _parts(blocks, expected)
    return blocks.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")


def _many(blocks: DataFrame, kind: int) -> int:
    return blocks.where(F.col("kind") == kind).agg(F.sum("n")).first()[0] or 0


def _dealer(source, kind: int, hot: np.ndarray, buckets: int):
    """Blocks by rank of the batches that ``source`` makes."""

    def stream(batches):
        for batch in source(batches):
            rows = _arrays(batch)
            yield kind, rows, _rank_key(rows["rank"], _is_hot(rows["rank"], hot), rows["doc"])

    return lambda batches: _pack(stream(batches), buckets)


def rounds(positions: DataFrame, expected: int, hot: np.ndarray, buckets: int) -> tuple[DataFrame, list[int]]:
    """Positions in blocks, after the last round, and the number of those that were open after each round.

    A round's table is emptied when the next one is written.
    """
    state = done = settle(_by_bucket(positions, expected).mapInArrow(_opener(hot, buckets), _BLOCKS), "open")
    many = _many(state, POSITION)
    left = []
    while True:
        paired = settle(_by_bucket(state, many).mapInArrow(_pairer(hot, buckets), _BLOCKS), "pairs")
        emptied(done)
        left.append(_many(paired, RANKED))
        if not left[-1]:
            return paired, left
        ranked = _by_bucket(paired.where(F.col("kind") == RANKED), left[-1]).mapInArrow(_closer(hot, buckets), _BLOCKS)
        state, done = paired.where(F.col("kind") == PLACED).unionByName(ranked), paired


def _ranks(hot: DataFrame) -> np.ndarray:
    return np.sort(np.array([r["rank"] for r in hot.select("rank").collect()], np.int64))  # HOT rows at most


def doubled(rows: DataFrame, expected: int, hot: DataFrame) -> tuple[DataFrame, list[int]]:
    """``rank, longer, doc, row, at`` of every stretch whose prefix is in several documents, from a table of positions.

    Also the number of positions that were open after each round.
    """
    ranks, buckets = _ranks(hot), _parts(rows, expected)
    state, left = rounds(rows.mapInArrow(_dealer(iter, POSITION, ranks, buckets), _BLOCKS), expected, ranks, buckets)
    return state.mapInArrow(lambda batches: map(_batch, _stretches(batches)), _PLAIN[STRETCH]), left


def _rerank(batches):
    """One pass over rows sorted by rank, longer rank and document.

    REPEAT: a row that is not of the first document of its longer rank. APART: a
    row of the first document, where the rank goes on in another way as well. EDGE:
    a row of the first document of a longer rank of which other parts have rows, too.
    """
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _arrays(batch)
        rows = rows if held is None else _joined([held, rows])
        rank, doc = rows["rank"], rows["doc"]
        longer = rows.get("longer", rank)
        start = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (longer[1:] != longer[:-1])])
        size = np.diff(np.r_[start, len(rank)])
        first = np.repeat(doc[start], size)
        same = rank[start][1:] == rank[start][:-1]
        apart = np.repeat(np.r_[before is not None and before == rank[0], same] | np.r_[same, False], size)
        # rows of the first document wait until it shows how their rank goes on
        wait = np.zeros(len(rank), bool)
        wait[start[-1] :] = doc[start[-1] :] == doc[start[-1]]
        if wait.sum() > HELD:
            apart[wait] = True
            wait[start[-1] + 1 :] = False
        held = _taken(rows, np.flatnonzero(wait))
        before = rank[start[-2]] if len(start) > 1 else before
        yield _kinds(rows, doc > first, apart, ~wait)
    if held is not None:
        yield _kinds(held, np.zeros(len(held["rank"]), bool), np.full(len(held["rank"]), before is not None and before == held["rank"][0]))


def _kinds(rows: dict, repeat: np.ndarray, apart: np.ndarray, ready=True) -> pa.RecordBatch:
    kind = np.where(repeat, REPEAT, np.where(rows["hot"], EDGE, APART)).astype(np.int32)
    keep = np.flatnonzero((repeat | apart | rows["hot"]) & ready)
    return _batch({"kind": kind[keep], **_taken({c: x for c, x in rows.items() if c != "hot"}, keep)})


def common(rows: DataFrame) -> DataFrame:
    """``rank, hot`` of the ranks that hold more than one in HOT of the rows: HOT of them at most."""
    counts = settle(rows.groupBy("rank").agg(F.count("*").alias("n")).where("n > 4"), "rank-counts")
    total = rows.count()
    return settle(counts.where(F.col("n") * HOT > total).select("rank", F.lit(True).alias("hot")), "common")


_PLAIN = {kind: ", ".join(f"{c} long" for c in _COLUMNS[kind]) for kind in (STRETCH, WINDOW)}


def _stretch_dealer(hot: np.ndarray, buckets: int):
    def stream(batches):
        for rows in _stretches(batches):
            yield STRETCH, rows, _rank_key(rows["rank"], _is_hot(rows["rank"], hot), rows["doc"])

    return lambda batches: _pack(stream(batches), buckets)


def _reranker(kind: int, hot: np.ndarray, buckets: int):
    """Repeats and those that are apart, by text or by document; edges stay as they are, without a place to go."""

    def stream(batches):
        for parts in _unpack(batches):
            rows = _met(parts[kind], hot)
            rows = _sorted(rows, "rank", "longer", "doc") if kind == STRETCH else rows
            for batch in _rerank([_batch(rows)]):
                rows = _arrays(batch)
                edge = _taken(rows, rows["kind"] == EDGE)
                yield kind, edge, np.arange(len(edge["doc"]))
                yield from _sent(kind, _taken(rows, rows["kind"] == REPEAT), _taken(rows, rows["kind"] == APART))

    return lambda batches: _pack(stream(batches), buckets)


def _sent(kind: int, repeats: dict, apart: dict):
    if kind == WINDOW:
        yield GONE, repeats, _named(repeats["doc"])
        return
    for to, rows in ((REPEAT, repeats), (APART, apart)):
        yield to, rows, _named(rows["doc"], rows["row"])


def _edge_dealer(kind: int, buckets: int):
    def stream(batches):
        for batch in batches:
            rows = _arrays(batch)
            yield from _sent(kind, _taken(rows, rows["repeat"]), _taken(rows, ~rows["repeat"]))

    return lambda batches: _pack(stream(batches), buckets)


def _edges(kind: int):
    return lambda batches: (_batch(parts[kind]) for parts in _unpack(batches))


def reranked(blocks: DataFrame, kind: int, expected: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """Sort the rows of the blocks by rank, longer rank and document: blocks of the repeats and of those that are apart.

    Without a longer rank the rank is all there is to compare.
    """
    names = [c for c in ("rank", "longer") if c in _COLUMNS[kind]]
    done = settle(_by_bucket(blocks, expected).mapInArrow(_reranker(kind, hot, buckets), _BLOCKS), "reranked")
    edges = settle(done.where(F.col("kind") == kind).mapInArrow(_edges(kind), _PLAIN[kind]), "edge-rows")
    ways = settle(edges.groupBy(*names).agg(F.min("doc").alias("first")), "edges")
    several = ways.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    met = edges.join(ways, names).withColumn("repeat", F.expr("doc > first")).drop("first")
    apart = met.where("NOT repeat").join(several, "rank", "left_semi").select(*met.columns)
    sent = met.where("repeat").unionByName(apart).mapInArrow(_edge_dealer(kind, buckets), _BLOCKS)
    return done.where(F.col("kind") != kind).unionByName(sent)


def _changes(rows: dict, *names: str) -> np.ndarray:
    """Where sorted rows differ from the row before in a column."""
    return np.logical_or.reduce([np.r_[True, rows[c][1:] != rows[c][:-1]] for c in names])


def _lister(kinds: dict[str, int], by: tuple[str, ...], value: str):
    """``by`` and a list of the different values of each kind."""

    def lists(batches):
        for parts in _unpack(batches):
            rows = _joined([
                {**{c: parts[kind][c] for c in (*by, value)}, "": np.full(len(parts[kind][value]), place)}
                for place, kind in enumerate(kinds.values()) if kind in parts
            ])
            rows = _sorted(rows, *by, "", value)
            new, other = _changes(rows, *by), _changes(rows, *by, "", value)
            kept, group, start = _taken(rows, other), (np.cumsum(new) - 1)[other], np.flatnonzero(new)
            columns = [pa.array(rows[c][start]) for c in by]
            for place in range(len(kinds)):
                own = kept[""] == place
                columns.append(A.lists(kept[value][own], np.bincount(group[own], minlength=len(start)), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*by, *kinds])

    return lists


def _among(values: np.ndarray, rows: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which of the values are in the list of their row."""
    out = np.zeros(len(values), bool)
    cut = np.searchsorted(rows, np.arange(len(lists) + 1))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(_has(lists)):
        known = flat[offsets[i] : offsets[i + 1]]
        out[cut[i] : cut[i + 1]] = np.isin(values[cut[i] : cut[i + 1]], known)
    return out


def _windows_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the runs, and the run of each."""
    many = last - first + 1
    run = np.repeat(np.arange(len(first)), many)
    return np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[run], run


def _window_ranker(text: str):
    def rank(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                doc = part.column("_doc").to_numpy(zero_copy_only=False)
                lists = part.column("apart")
                for data, bounds, start in _pieces(part, text, LENGTH):
                    first, last, row, at, _, total = stretches(data, bounds)
                    open_ = _among(_packed(start, first, last, row, at, bounds), row, lists)
                    window, run = _windows_of(first[open_], last[open_])
                    name = A.signed(A.spans_hash(total, window, window + LENGTH))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), pa.array(doc[row[open_][run]], pa.int64())], ["rank", "doc"]
                    )

    return rank


def _remover(text: str):
    def remove(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                some = part.column("copy").to_numpy(zero_copy_only=False) | _has(part.column("stretches")) | _has(part.column("windows"))
                rest = part.filter(pa.array(~some))
                data, bounds = A.raw(rest.column(text))
                yield _left(rest, [[]] * len(rest), [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], bounds)
                part = part.filter(pa.array(some))
                data, bounds = A.raw(part.column(text))
                step = np.zeros(len(data) + 1, np.int32)
                for piece, inner, start in _pieces(part, text, LENGTH):
                    first, last, row, at, _, total = stretches(piece, inner)
                    place = _packed(start, first, last, row, at, inner)
                    gone = _among(place, row, part.column("stretches"))
                    np.add.at(step, start + first[gone], 1)
                    np.add.at(step, start + last[gone] + LENGTH, -1)
                    some = np.flatnonzero(_has(part.column("windows"))[row])
                    some = some[_among(place[some], row[some], part.column("apart"))]
                    window, run = _windows_of(first[some], last[some])
                    name = A.signed(A.spans_hash(total, window, window + LENGTH))
                    hit = window[_among(name, row[some][run], part.column("windows"))]
                    np.add.at(step, start + hit, 1)
                    np.add.at(step, start + hit + LENGTH, -1)
                copied = part.column("copy").to_numpy(zero_copy_only=False) & (np.diff(bounds) >= LENGTH)
                np.add.at(step, bounds[:-1][copied], 1)
                np.add.at(step, bounds[1:][copied], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept, spans = [], []
                for i in range(len(part)):
                    own = gone[bounds[i] : bounds[i + 1]]
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                    kept.append(data[bounds[i] : bounds[i + 1]][~own].tobytes())
                yield _left(part, spans, kept, bounds)

    return remove


def _left(part: pa.RecordBatch, spans: list, kept: list, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [part.column("_key"), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
        ["_key", "n_bytes", "spans", "kept"],
    )


def _has(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()) > 0


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, spans, kept`` of each row: removed byte ranges and the bytes that are left.

    A byte goes if a string of LENGTH bytes covers it that also starts in a text
    with a smaller key. Null and short texts lose nothing; null keys are larger
    than all others; rows with equal keys do not affect each other, and repeated
    rows each have the same result. Other columns are ignored. Strings are told
    apart by hashes: a prefix and its way for a stretch, 64 bits each, and 64 bits for a window.
    """
    every = documents.select(
        F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.col(text).alias("_text"),
        F.xxhash64(F.lit(1), text).alias("_h1"), F.xxhash64(F.lit(2), text).alias("_h2"),
    )
    # a text that a smaller key has as well goes as a whole, and ranks nothing
    names = ["_h1", "_h2"]
    prints = settle(every.select("_doc", *names), "prints")
    firsts = prints.groupBy(*names).agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).where("first < last")
    copies = settle(
        prints.join(firsts, names).where("_doc > first").select("_doc", *names).distinct().withColumn("copy", F.lit(True)), "copies"
    )
    every = every.join(broadcast_if_small(copies, 64), ["_doc", *names], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    source = every.where("NOT copy")
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    spread_by = (LENGTH - PREFIX + 2) // 2  # bytes for each chosen position

    def positions(of: DataFrame) -> DataFrame:
        return of.select("_doc", "_h1", "_text").mapInArrow(_positions("_text"), "rank long, doc long, row long, at long")

    one_in = max(1, source.count() // SAMPLE)
    hot = _ranks(common(positions(source.where(F.pmod(F.xxhash64("_doc"), F.lit(one_in)) == 0))))
    expected = size // spread_by
    buckets = _parts(source, expected)
    dealt = source.select("_doc", "_h1", "_text").mapInArrow(_dealer(_positions("_text"), POSITION, hot, buckets), _BLOCKS)
    state, _ = rounds(dealt, expected, hot, buckets)
    many = _many(state, PLACED)
    sent = reranked(state.mapInArrow(_stretch_dealer(hot, buckets), _BLOCKS), STRETCH, many, hot, buckets)
    lists = _lister({"stretches": REPEAT, "apart": APART}, ("doc", "row"), "at")
    texts = settle(
        _by_bucket(sent, many).mapInArrow(lists, "doc long, row long, stretches array<long>, apart array<long>"), "texts"
    )
    emptied(state)
    ways = texts.where("size(apart) > 0")

    def ranked(of: DataFrame, then, columns: str) -> DataFrame:
        return (
            source.select("_doc", "_h1", "_text")
            .join(of.select("doc", "row", "apart"), (F.col("_doc") == F.col("doc")) & (F.col("_h1") == F.col("row")))
            .select("_doc", "_text", "apart").mapInArrow(then, columns)
        )

    one_in = max(1, ways.count() // SAMPLE)
    windows = _window_ranker("_text")
    hot = _ranks(common(ranked(ways.where(F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0), windows, _PLAIN[WINDOW])))
    expected = (ways.agg(F.sum(F.size("apart"))).first()[0] or 0) * spread_by
    buckets = _parts(source, expected)
    again = reranked(ranked(ways, _dealer(windows, WINDOW, hot, buckets), _BLOCKS), WINDOW, expected, hot, buckets)
    single = _by_bucket(again, expected).mapInArrow(_lister({"windows": GONE}, ("doc",), "rank"), "doc long, windows array<long>")
    found = settle(texts.join(single, "doc", "left"), "found")
    none = F.array().cast("array<bigint>")
    joined = every.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_h1") == F.col("row")), "left").select(
        "_key", "_text", F.coalesce("stretches", none).alias("stretches"), F.coalesce("windows", none).alias("windows"),
        F.coalesce("apart", none).alias("apart"), "copy",
    )
    kind = documents.schema[key].dataType.simpleString()
    return joined.mapInArrow(_remover("_text"), f"_key {kind}, n_bytes long, spans array<{SPAN}>, kept binary").withColumnRenamed("_key", key)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeats of earlier documents each document loses."""
    done = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
