"""Benchmark decontamination by spaced seeds.

A seed is a window of words hashed at the positions of a fixed mask; the other
positions may differ. Test items are hashed at every position, documents are
scanned for equal hashes, and each hit names a document, an item and a diagonal.
The words along the diagonal are then compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.session import settle

#: Fixed masks, 1 where the word counts. One substitution leaves most of the
#: eight-word windows of a passage whole, two neighbours leave the masked ones.
MASKS = ("11111", "1101011", "10110011", "11001101")
#: More of them for items of five to seven words, of which any one may differ: one of
#: these, four words each, leaves the place out wherever it is.
SHORT, SHORT_MASKS = 7, ("1111", "110011", "10111", "11011", "11101")
#: Least length of an overlap in words (or the whole item if it is shorter), and
#: least share of equal words in it, in hundredths.
MIN_WORDS = 13
LEAST = 80
#: Words of test items that are held by a task at once; a larger benchmark is
#: met in several passes over the documents.
BLOCK_WORDS = 2_000_000

#: Letters and digits of ASCII and all bytes of other characters make words.
WORDY = np.zeros(256, dtype=bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_AS_SPACE = np.where(WORDY, np.arange(256), 32).astype(np.uint8)

LEAK = "struct<item:bigint,first_word:bigint,words:bigint,equal_words:bigint>"
_LEAK = pa.struct([("item", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("equal_words", pa.int64())])


def text_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word; punctuation separates words, case is ignored (A-Z)."""
    _, _, rows, hashes = A.word_hashes(_AS_SPACE[data], bounds)
    return rows, hashes


def seeds(rows: np.ndarray, hashes: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of ``mask`` that lies within one row."""
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.full(n, len(mask) * 257 + int(mask, 2), np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    inside = np.flatnonzero(A.whole(rows, len(mask)))
    return inside, A.mix(out[inside])


class Items:
    """Seeds of one block of test items, sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = [w for _, w in items]
        rows = np.repeat(np.arange(len(items)), [len(w) for w in self.words])
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        begin = np.r_[0, np.cumsum([len(w) for w in self.words])]
        few = np.isin(rows, [k for k, w in enumerate(self.words) if len(MASKS[0]) <= len(w) <= SHORT])
        self.masks = MASKS + SHORT_MASKS if few.any() else MASKS
        found = [seeds(rows, flat, m) for m in MASKS]
        if few.any():
            place = np.flatnonzero(few)
            found += [(place[at], name) for at, name in (seeds(rows[few], flat[few], m) for m in SHORT_MASKS)]
        start = np.concatenate([s for s, _ in found])
        name = np.concatenate([h for _, h in found])
        # an item shorter than a mask is one seed of its own length
        self.short = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < len(MASKS[0]):
                self.short.setdefault(len(w), {}).setdefault(int(A.gram_hashes(w, len(w))[0]), []).append(k)
        order = np.argsort(name, kind="stable")
        self.name = name[order]
        self.item = rows[start[order]] if len(rows) else np.zeros(0, int)
        self.place = start[order] - begin[self.item] if len(rows) else np.zeros(0, int)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.name >> np.uint64(42)] = True

    def diagonals(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Distinct (item, word of the slice that the item's first word would be, row)."""
        out = []
        for mask in self.masks:
            start, name = seeds(rows, hashes, mask)
            maybe = np.flatnonzero(self.table[name >> np.uint64(42)])
            start, name = start[maybe], name[maybe]
            low, high = np.searchsorted(self.name, name), np.searchsorted(self.name, name, "right")
            many = high - low
            if not many.any():
                continue
            at = np.repeat(start, many)
            hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            out.append(np.stack([self.item[hit], at - self.place[hit], rows[at]], 1))
        for width, known in self.short.items():
            name = A.gram_hashes(hashes, width)
            wanted = np.array(sorted(known), np.uint64)
            for at in np.flatnonzero(np.isin(name, wanted) & A.whole(rows, width)):
                out.extend(np.array([[k, at, rows[at]]]) for k in known[int(name[at])])
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), int)


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Longest stretch with at least LEAST hundredths of equal words: start, length, equal.

    Among running sums of (equal ? 100 - LEAST : -LEAST) it is the widest pair that does
    not fall; candidates for its start are the running minima.
    """
    total = np.r_[0, np.cumsum(np.where(equal, 100 - LEAST, -LEAST))]
    lows = np.flatnonzero(np.r_[True, total[1:] < np.minimum.accumulate(total)[:-1]])
    best = (0, 0)
    at = len(lows) - 1
    for end in range(len(total) - 1, 0, -1):
        if at < 0:
            break
        while at >= 0 and total[lows[at]] <= total[end]:
            if end - lows[at] > best[1]:
                best = (int(lows[at]), int(end - lows[at]))
            at -= 1
    start, length = best
    return start, length, int(equal[start : start + length].sum())


def overlaps(items: Items, rows: np.ndarray, hashes: np.ndarray) -> dict[int, list[dict]]:
    """Leaks by row of the slice: the longest overlap with each item."""
    first = np.searchsorted(rows, np.arange((rows[-1] if len(rows) else 0) + 2))
    found: dict[tuple[int, int], tuple] = {}
    for k, origin, row in items.diagonals(rows, hashes):
        words = items.words[k]
        begin, end = max(origin, first[row]), min(origin + len(words), first[row + 1])
        if len(words) < len(MASKS[0]) and first[row + 1] - first[row] != len(words):
            continue  # a few words stand for an item only where they are the whole text
        equal = hashes[begin:end] == words[begin - origin : end - origin]
        start, length, same = best_overlap(equal)
        if length >= min(MIN_WORDS, len(words)):
            leak = (length, same, -(begin + start - first[row]))
            if leak > found.get((row, k), (0,)):
                found[row, k] = leak
    out: dict[int, list[dict]] = {}
    for (row, k), (length, same, start) in sorted(found.items()):
        out.setdefault(int(row), []).append(
            {"item": int(items.ids[k]), "first_word": int(-start), "words": int(length), "equal_words": int(same)}
        )
    return out


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The test items in blocks of bounded size, read to the driver one at a time."""
    kept = settle(
        benchmark.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL"), "items"
    )
    size = kept.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word and its space are two characters at least
    for block in range(count):
        part = kept.where(F.pmod(F.xxhash64("id"), F.lit(count)) == block).toArrow().sort_by("id").combine_chunks()
        items = []
        for batch in part.to_batches():
            rows, hashes = text_words(*A.raw(batch.column("text")))
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            numbers = batch.column("id").fill_null(-1).to_pylist()
            items += [(i, hashes[cut[r] : cut[r + 1]]) for r, i in enumerate(numbers)]
        yield Items(items)


def with_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``documents`` with ``leaks``: for each test item found in the text its longest overlap.

    An overlap has at least MIN_WORDS words (or the item's length if that is
    less) of which LEAST hundredths are equal, word by word; ``first_word`` is
    its place in the document. An item of fewer words than a seed needs is found
    where it is the whole text. Null and empty texts and items have none; items
    without a number are reported as -1. A column named ``leaks`` is replaced, and all rows and other
    columns stay. A block of the benchmark is sent to the tasks, at most
    BLOCK_WORDS words; each further block is one more pass over the documents.
    """
    documents = documents.drop("leaks").withColumn("leaks", F.lit(None).cast(f"array<{LEAK}>"))
    for items in _blocks(benchmark, item_key, item_text):
        sent = documents.sparkSession.sparkContext.broadcast(items)
        documents = documents.mapInArrow(_finder(sent, text), documents.schema)
    return documents.withColumn("leaks", F.coalesce("leaks", F.array().cast(f"array<{LEAK}>")))


def _finder(sent, text: str):
    def find(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                rows, hashes = text_words(*A.raw(part.column(text)))
                found = overlaps(sent.value, rows, hashes)
                at = part.schema.get_field_index("leaks")
                held = part.column(at)
                if found:
                    leaks = [(x or []) + found.get(i, []) for i, x in enumerate(held.to_pylist())]
                    held = pa.array(leaks, pa.list_(_LEAK))
                yield part.set_column(at, "leaks", held.cast(pa.list_(_LEAK)))

    return find


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item found in every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return with_leaks(documents, benchmark).select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), "leak.first_word", "leak.words", "leak.equal_words"
    )


def leaks_nothing() -> Column:
    return F.size("leaks") == 0
