"""Alignment of two tokenizers' outputs by diagonal run skipping.

Both tokenizers cut the same bytes. Where the k-th token of one and the k-th
token, plus a shift, of the other end together, a run of one-to-one groups
begins: its length is found by probing the two arrays of ends at this shift with
stretches of 1, 2, 4, ... tokens and halving back from the first that differs.
Between runs both sides move on until they end together again, which makes one
irregular group and a new shift.

Every text is cut and aligned once. Its distinct linked pairs and how often they
occur go to a written table; the number of texts that hold a pair is summed from
it, first inside each task, and comes back to the texts by lookup.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.llm import bpe
from versetide.session import settle

#: Rows that a task holds before it hands out its counts of pairs.
PAIRS_HELD = 1 << 20
#: Bytes of the counts of pairs that are sent to every task; a larger table is joined.
SENT_BYTES = 64 << 20
#: An id pair is one number: the first id times this, and the second.
WIDE = 1 << 32

Groups = tuple[list[int], list[int], list[int], list[int]]


def align(left: list[int], right: list[int]) -> Groups:
    """Groups and links of two rising lists of ends, the last of which are equal.

    Gives the number of left and of right tokens that end with each group, and
    the left and right token of each link, in order: all pairs that share a byte.
    """
    count = len(left)
    left, right = [*left, -1, -1], [*right, -2, -2]  # no stretch beyond the last token is equal
    left_ends: list[int] = []
    right_ends: list[int] = []
    left_links: list[int] = []
    right_links: list[int] = []
    i = j = 0
    while i < count:
        a, b = left[i], right[j]
        if a == b:
            p, q, step = i + 1, j + 1, 1
            while left[p : p + step] == right[q : q + step]:
                p += step
                q += step
                step += step
            while step > 1:
                step >>= 1
                if left[p : p + step] == right[q : q + step]:
                    p += step
                    q += step
            left_links += range(i, p)
            right_links += range(j, q)
            left_ends += range(i + 1, p + 1)
            right_ends += range(j + 1, q + 1)
            i, j = p, q
        else:
            while a != b:
                left_links.append(i)
                right_links.append(j)
                if a < b:
                    i += 1
                    a = left[i]
                else:
                    j += 1
                    b = right[j]
            left_links.append(i)
            right_links.append(j)
            i += 1
            j += 1
            left_ends.append(i)
            right_ends.append(j)
    return left_ends, right_ends, left_links, right_links


class Pair:
    """Two vocabularies: a byte-level one, which is given a space before the text, and one of pieces, which adds it."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.left = bpe.codec(byte_level)
        self.right = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.left_bytes = [self.left.encoding.decode_single_token_bytes(i) if n else b"" for i, n in enumerate(self.left.sizes)]
        self.right_bytes = [self._piece(i) for i in range(self.right.get_piece_size())]
        self.left_sizes, self.right_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.left_bytes, self.right_bytes))
        # each id as it is written, with what stands behind it: inside a group, at its end, and the same for the right side
        counts = len(self.left_bytes), len(self.right_bytes)
        shown = np.array([b"%d%b" % (i, end) for n, ends in zip(counts, ((b",", b"|"), (b",", b";"))) for end in ends for i in range(n)])
        self.shown = shown.view(np.uint8).reshape(len(shown), -1)  # filled up with zeros

    def _piece(self, i: int) -> bytes:
        if self.right.is_byte(i):
            return bytes([int(self.right.id_to_piece(i)[3:5], 16)])
        return self.right.id_to_piece(i).replace("▁", " ").encode()

    def cut(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not those of space and text."""
        out, none = [], np.zeros(0, np.int64)
        for text, pieces in zip(texts, self.right.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            left = self.left.encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64) if text else none
            # the left side drops no byte and changes none, so its length tells
            same = text and self.left_sizes[left].sum() == len(whole) and b"".join(map(self.right_bytes.__getitem__, pieces)) == whole
            out.append((left, np.array(pieces, np.int64)) if same else (none, none))
        return out

    def show(self, left: np.ndarray, right: np.ndarray, left_ends: list[int], right_ends: list[int]) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        if not len(left):
            return b""
        ends = np.array(left_ends), np.array(right_ends)
        sizes = [np.diff(e, prepend=0) for e in ends]
        # how many tokens of the other side stand before each token: those of the groups before, and its own on the right
        place = np.repeat(ends[1] - sizes[1], sizes[0]) + np.arange(len(left)), np.repeat(ends[0], sizes[1]) + np.arange(len(right))
        line = np.empty(len(left) + len(right), np.int64)
        for side, ids, n, base in ((0, left, len(self.left_bytes), 0), (1, right, len(self.right_bytes), 2 * len(self.left_bytes))):
            name = ids + base
            name[ends[side] - 1] += n
            line[place[side]] = name
        shown = self.shown[line].ravel()
        return shown[shown != 0][:-1].tobytes()


@functools.lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    """The two vocabularies, read once by each worker."""
    return Pair(byte_level, pieces)


def _aligner(paths: tuple[str, str], keep: tuple[str, ...], groups: bool):
    """Alignment of each row. With ``groups`` the ids and bounds, else counts, a digest and the pairs."""

    def run(batches):
        both = pair(*paths)
        for batch in batches:
            for part in A.slices(batch, "_text"):
                rows = []
                for left, right in both.cut([x or "" for x in part.column("_text").to_pylist()]):
                    left_ends, right_ends, left_links, right_links = align(
                        np.cumsum(both.left_sizes[left]).tolist(), np.cumsum(both.right_sizes[right]).tolist()
                    )
                    if groups:
                        rows.append((left, right, left_ends, right_ends))
                        continue
                    pairs, times = np.unique(left[left_links] * WIDE + right[right_links], return_counts=True)
                    digest = hashlib.sha256(both.show(left, right, left_ends, right_ends)).hexdigest() if len(left) else ""
                    rows.append((len(left), len(right), len(left_ends), len(left_links), digest, pairs, times))
                kept = [part.column(c) for c in keep]
                columns = list(zip(*rows))
                if groups:
                    made = [pa.array(c, pa.list_(pa.int32())) for c in columns]
                    yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "a_ids", "b_ids", "a_ends", "b_ends"])
                else:
                    sizes = np.array([len(p) for p in columns[5]], np.int64)
                    lists = [A.lists(np.concatenate(columns[5]), sizes, pa.int64()), A.lists(np.concatenate(columns[6]).astype(np.int32), sizes, pa.int32())]
                    made = [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *lists]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, *made], [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                    )

    return run


def _source(documents: DataFrame, text: str, keep: tuple[str, ...]):
    names = tuple(f"_k{i}" for i in range(len(keep)))
    source = documents.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(n) for n, c in zip(names, keep)))
    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    return source, names, kinds


def aligned(documents: DataFrame, paths: tuple[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep, a_ids, b_ids, a_ends, b_ends``: ids of both sides, and their number up to the end of each group.

    A text that is null or empty, or that a side does not give back, has empty
    lists. Repeated rows and rows without a key stay; other columns are ignored.
    """
    source, names, kinds = _source(documents, text, keep)
    out = source.mapInArrow(_aligner(paths, names, True), f"{kinds}a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "a_ids", "b_ids", "a_ends", "b_ends")


def _adder(batches):
    """Rows of (pair, texts) from lists of distinct pairs, added up while they fit."""
    held, texts, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge():
        every = np.concatenate([held, *fresh])
        weight = np.concatenate([texts, np.ones(len(every) - len(held), np.int64)])
        names, where = np.unique(every, return_inverse=True)
        return names, np.bincount(where, weight, len(names)).astype(np.int64)

    for batch in batches:
        pairs = pc.list_flatten(batch.column("pairs")).to_numpy(zero_copy_only=False)
        fresh.append(pairs)
        waiting += len(pairs)
        if waiting >= PAIRS_HELD:
            held, texts = merge()
            fresh, waiting = [], 0
            if len(held) >= PAIRS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(texts)], ["pair", "texts"])
                held, texts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if fresh or len(held):
        held, texts = merge()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(texts)], ["pair", "texts"])


def pair_texts(rows: DataFrame) -> DataFrame:
    """``pair, texts, best``: the number of texts that hold each linked pair, and whether no pair of its first id has more."""
    sums = settle(rows.select("pairs").mapInArrow(_adder, "pair bigint, texts bigint").groupBy("pair").agg(F.sum("texts").alias("texts")), "pair-texts")
    first = F.shiftright("pair", 32)
    most = sums.groupBy(first.alias("_a")).agg(F.max("texts").alias("_most"))  # as many rows as ids at most
    return sums.join(most, first == F.col("_a")).select("pair", "texts", (F.col("texts") == F.col("_most")).alias("best"))


def _lookup(sent, keep: tuple[str, ...]):
    """Adds ``n_best`` and ``count_sum`` by lookup of every pair in the sent table."""

    def run(batches):
        names, texts, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
            times = pc.list_flatten(batch.column("times")).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.searchsorted(names, pc.list_flatten(lists).to_numpy(zero_copy_only=False))
            sums = [np.r_[0, np.cumsum(x)] for x in (times * best[place], times * texts[place])] if len(names) else [np.zeros(1, np.int64)] * 2
            made = [pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "n_best", "count_sum"])

    return run


def link_digests(
    documents: DataFrame, paths: tuple[str, str], key: str = "doc_id", text: str = "text", sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    A link's count is the number of rows that hold its pair of ids linked. ``n_best``
    counts the links with the largest count of their first id, ties included, and
    ``count_sum`` adds up the counts. Texts without tokens have zeros and an empty
    digest. Rows that share a key count each.
    """
    spark = documents.sparkSession
    source, names, kinds = _source(documents, text, (key,))
    kind = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    rows = settle(
        source.mapInArrow(_aligner(paths, names, False), f"{kinds}{kind}, pairs array<bigint>, times array<int>"), "aligned"
    )
    counts = settle(pair_texts(rows), "pair-counts")
    plain = [F.col("_k0").alias(key), "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() * 17 <= sent_bytes:
        table = counts.toArrow().combine_chunks().sort_by("pair")  # sent_bytes at most
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "texts", "best")))
        kept = ("_k0", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        out = rows.mapInArrow(_lookup(sent, kept), f"{kinds}{kind}, n_best bigint, count_sum bigint")
        return out.select(*plain, "n_best", "count_sum", "groups_sha256")
    # a row may share its key, so it gets a number of its own in a written table
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_row", "_p.pairs", "_p.times")
    sums = each.join(counts, F.col("pairs") == F.col("pair")).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("texts")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, "_row", "left").select(*plain, *zero, "groups_sha256")


def vocabularies() -> tuple[str, str]:
    return bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's alignment by counts and a digest."""
    return link_digests(spark.read.parquet(f"{folder}/documents.parquet"), vocabularies())
