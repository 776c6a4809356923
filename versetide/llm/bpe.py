"""Byte-pair encoding with chunk reuse.

Texts are cut where a rolling hash of their last bytes has a fixed pattern, so
passages that texts share are mostly cut alike. Each chunk that occurs twice or
more is encoded once. A text with such chunks is put together from their ids
and from its own; around every cut the text between two safe places is encoded
again. A safe place stands between a letter and a space with a letter behind it:
the splitting pattern always ends a piece there, whatever is around it. The ids
to the left and right must end there too, else the whole text is encoded.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.session import broadcast_if_small, settle

#: Bytes that the rolling hash sees, and bits that must be zero at a cut.
WINDOW = 32
CUT_BITS = 10


class Codec:
    """Encoder and decoder of a byte-level vocabulary file of the tokenizers library.

    The ids of such a vocabulary follow the order of its merges, which makes
    them ranks; this is verified when it is read. Added tokens are split off
    where they stand in a text, as the library does by default.
    """

    #: Fixed value: the splitting pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        byte_of = {c: b for b, c in self._shown().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        for k, merge in enumerate(spec["model"]["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            if vocab["".join(pair)] != 256 + k:
                raise ValueError("the ids of this vocabulary are not in the order of its merges")
        self.added = added
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.sizes[i] = len(token)

    @staticmethod
    def _shown() -> dict[int, str]:
        """The character that stands for each byte: itself if it is visible, else the next from 256 on."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding.encode(data.decode("utf-8"), allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of ``path``, read once by each worker."""
    return Codec(path)


_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def safe_places(data: np.ndarray) -> np.ndarray:
    """Bytes where a letter ends and a space with a letter behind it begins, and both ends of the text."""
    inner = np.flatnonzero(_letter[data[:-2]] & (data[1:-1] == 32) & _letter[data[2:]]) + 1 if len(data) > 2 else np.zeros(0, int)
    return np.r_[0, inner, len(data)]


def cuts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each row its chunk bounds, from 0 to its length; never inside a character."""
    total = A.sums(A.BYTE[data])
    ends = np.arange(WINDOW, len(data))
    name = A.spans_hash(total, ends - WINDOW, ends)
    at = ends[((name >> np.uint64(64 - CUT_BITS)) == 0) & ((data[ends] & 0xC0) != 0x80)]
    row = np.searchsorted(bounds, at, "right") - 1
    inside = at - bounds[row] >= WINDOW
    at, row = at[inside] - bounds[row[inside]], row[inside]
    split = np.searchsorted(row, np.arange(len(bounds)))
    return [np.r_[0, at[split[i] : split[i + 1]], bounds[i + 1] - bounds[i]] for i in range(len(bounds) - 1)]


def chunk_names(data: np.ndarray, bounds: np.ndarray, cut: list[np.ndarray]) -> list[list[bytes]]:
    """128-bit name of each chunk of each row."""
    out = []
    for i, c in enumerate(cut):
        row = data[bounds[i] : bounds[i + 1]].tobytes()
        out.append([hashlib.blake2b(row[c[k] : c[k + 1]], digest_size=16).digest() for k in range(len(c) - 1)])
    return out


def _namer(text: str):
    def name(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                data, bounds = A.raw(part.column(text))
                names = chunk_names(data, bounds, cuts(data, bounds))
                count = np.array([len(x) for x in names], np.int64)
                place = np.concatenate([np.arange(n) for n in count]) if len(count) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").take(pa.array(np.repeat(np.arange(len(count)), count))),
                     pa.array(place, pa.int32()), pa.array([x for row in names for x in row], pa.binary())],
                    ["_key", "place", "name"],
                )

    return name


def _chunk_encoder(path: str, text: str):
    def encode(batches):
        code = codec(path)
        for batch in batches:
            for part in A.slices(batch, text):
                data, bounds = A.raw(part.column(text))
                cut = cuts(data, bounds)
                names, ids = [], []
                for i, places in enumerate(part.column("places").to_pylist()):
                    row = data[bounds[i] : bounds[i + 1]].tobytes()
                    for k in sorted(set(places)):
                        if k < len(cut[i]) - 1:
                            piece = row[cut[i][k] : cut[i][k + 1]]
                            names.append(hashlib.blake2b(piece, digest_size=16).digest())
                            ids.append(code.encode(piece).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["name", "ids"])

    return encode


def assemble(row: bytes, cut: np.ndarray, known: dict[int, np.ndarray], code: Codec) -> np.ndarray:
    """Ids of ``row``: ``known`` chunks by their number, everything else encoded here."""
    data = np.frombuffer(row, np.uint8)
    safe = safe_places(data)
    # neighbours that are not known are one piece
    edges = [int(cut[0])] + [int(cut[k]) for k in range(1, len(cut) - 1) if k in known or k - 1 in known] + [int(cut[-1])]
    number = {int(cut[k]): k for k in known}
    windows: list[list[int]] = []  # stretches around inner edges that are encoded again
    for q in edges[1:-1]:
        low = int(safe[np.searchsorted(safe, q, "right") - 1])
        high = int(safe[np.searchsorted(safe, q)])
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    out, at, w = [], 0, 0
    marks = [x for pair in windows for x in pair]
    stops = [0, *marks, len(row)]
    for k in range(0, len(stops) - 1, 2):
        low, high = stops[k], stops[k + 1]  # between two windows: inside one piece
        if low < high:
            piece = max(i for i, e in enumerate(edges[:-1]) if e <= low)
            start, end = edges[piece], edges[piece + 1]
            if start in number:
                ids = known[number[start]]
                place = np.r_[0, np.cumsum(code.sizes[ids])]
                a, b = np.searchsorted(place, (low - start, high - start))
                if place[-1] != end - start or place[a] != low - start or place[b] != high - start:
                    return code.encode(row)  # the two sides do not agree here
                out.append(ids[a:b])
            else:
                out.append(code.encode(row[low:high]))
        if k + 2 < len(stops) and stops[k + 1] < stops[k + 2]:
            out.append(code.encode(row[stops[k + 1] : stops[k + 2]]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _encoder(path: str, text: str, keep: tuple[str, ...]):
    """Rows with their ids; ``places`` and ``pieces`` hold the chunks that are known."""
    def encode(batches):
        code = codec(path)
        for batch in batches:
            for part in A.slices(batch, text):
                data, bounds = A.raw(part.column(text))
                shared = "pieces" in part.schema.names
                cut = cuts(data, bounds) if shared else None
                pieces = part.column("pieces").to_pylist() if shared else [None] * len(part)
                ids, decoded = [], []
                for i, piece in enumerate(pieces):
                    row = data[bounds[i] : bounds[i + 1]].tobytes()
                    if piece:
                        known = {x["place"]: np.frombuffer(x["ids"], np.uint32) for x in piece if x["place"] < len(cut[i]) - 1}
                        got = assemble(row, cut[i], known, code)
                    else:
                        got = code.encode(row)
                    ids.append(got.astype("<u4").tobytes())
                    decoded.append(code.decode(got))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    [*keep, "ids", "decoded"],
                )

    return encode


def shared_chunks(documents: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """``_key, pieces``: for each row with chunks that occur elsewhere, their numbers and ids.

    Names are counted where they are made, so a chunk of a third of all rows is
    a row for each task. Each chunk is encoded in the text that holds its first
    place.
    """
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL")
    kind = source.schema["_key"].dataType.simpleString()
    names = settle(source.mapInArrow(_namer("_text"), f"_key {kind}, place int, name binary"), "chunks")
    twice = settle(
        names.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("_key", "place")).alias("first")).where("n > 1"),
        "shared",
    )
    homes = settle(
        twice.groupBy(F.col("first._key").alias("_home")).agg(F.collect_set("first.place").alias("places")), "homes"
    )
    encoded = settle(
        source.join(broadcast_if_small(homes, 64), F.col("_key") == F.col("_home"))
        .select("_text", "places").mapInArrow(_chunk_encoder(path, "_text"), "name binary, ids binary").dropDuplicates(["name"]),
        "encoded",
    )
    # a key that stands on several rows names different texts: such rows are encoded whole
    single = names.where("place = 0").groupBy("_key").agg(F.count("*").alias("rows")).where("rows > 1")
    return (
        names.join(encoded, "name").join(single, "_key", "left_anti")
        .groupBy("_key").agg(F.collect_list(F.struct("place", "ids")).alias("pieces"))
    )


def encode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` and ``decoded`` of each row.

    ``ids`` holds unsigned 32-bit integers, little-endian, one after the other.

    A null text counts as empty, an empty one has no ids. Rows without a key and
    rows that share a key are encoded without reuse; repeated rows stay. Columns
    not in ``keep`` are ignored. ``path`` must exist on every worker.
    """
    wanted = [F.col(key).alias("_key"), F.col(text).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))]
    source = documents.select(*wanted)
    names = tuple(f"_k{i}" for i in range(len(keep)))
    types = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{types}, ids binary, decoded string" if keep else "ids binary, decoded string"
    pieces = settle(shared_chunks(documents, path, key, text), "pieces")
    mark = broadcast_if_small(pieces.select(F.col("_key").alias("_mark")), 16)
    plain = source.join(mark, F.col("_key") == F.col("_mark"), "left_anti").mapInArrow(_encoder(path, "_text", names), schema)
    mixed = (
        source.join(mark, F.col("_key") == F.col("_mark"), "left_semi").join(pieces, "_key")
        .mapInArrow(_encoder(path, "_text", names), schema)
    )
    out = plain.unionByName(mixed)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "ids", "decoded")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, by count and hashes."""
    encoded = encode(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary())
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
