"""Secret scans: strong patterns, and weak parts linked by an interval join.

Strong spans follow the base patterns. An identifier, a secret-looking string or
an endpoint proves little alone; such a weak span is reported when a part that
completes it starts or ends within REACH of it. The parts of all texts are one
table, and the join is by text and by a grid of REACH, so it meets few rows. Parts
may be of any length.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.session import broadcast_if_small, settle

#: Base patterns, in the order in which kinds are listed. A shorter
#: match is dropped after it has used up its text.
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is one match, so this is + with the short ones dropped
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Weak parts: names of accounts or keys, strings that may be keys, and addresses.
NAME = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+")
LONG_WORD = re.compile(r"[a-z]{8,}|[A-Z]{8,}")
ENDPOINT = re.compile(
    r"\b(?:https?|wss?|ftps?|ssh|amqps?|redis|postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s\"'<>]{4,}"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])"
)
#: Listing order of the kinds; ties in the start are told apart by it.
KINDS = ("assign", "access", "hex", "name", "opaque", "endpoint")
#: What each kind is a part of: i identifier, s secret, e endpoint.
ROLE = {"assign": "s", "access": "i", "hex": "s", "name": "i", "opaque": "s", "endpoint": "e"}
#: Code points between two parts of one credential.
REACH = 200

SPAN = "struct<start:bigint,kind:int,stop:bigint>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` in code points, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(text: str) -> bool:
    """Upper case, lower case and digits, and at most an eighth of it in long words.

    A random string has letters of one case in a row by chance, the more the
    longer it is, so the share counts.
    """
    return (
        any(c.isupper() for c in text) and any(c.islower() for c in text) and sum(c.isdigit() for c in text) >= 3
        and 8 * sum(m.end() - m.start() for m in LONG_WORD.finditer(text)) <= len(text)
    )


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that no strong span covers."""
    out = [(m.start(), 3, m.end()) for m in NAME.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _mixed(m[0])]
    out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    # a strong span covers one if, of those that start before its end, the furthest end lies behind its start
    starts, ends = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))
    return sorted(x for x in out if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[0])


def _parts(text_column: str):
    def parts(batches):
        for batch in batches:
            for part in A.slices(batch, text_column):
                base, weak = [], []
                for text in part.column(text_column).to_pylist():
                    text = text or ""
                    found = base_spans(text)
                    base.append([dict(zip(("start", "kind", "stop"), x)) for x in found])
                    weak.append([dict(zip(("start", "kind", "stop"), x)) for x in weak_spans(text, found)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_hash"), pa.array(base, pa.list_(_SPAN)), pa.array(weak, pa.list_(_SPAN))],
                    ["_id", "_hash", "base", "weak"],
                )

    return parts


def _identified(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Rows are told apart by key and text, so rows that are equal in both are one."""
    return documents.withColumns({
        "_id": F.col(key), "_hash": F.struct(F.xxhash64(text), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("string"),
    })


def linked_weak(parts: DataFrame) -> DataFrame:
    """``_id, _hash, linked``: weak spans with a complementary part within REACH, in order.

    An identifier is completed by a secret, a secret by an identifier or an
    endpoint, an endpoint by a secret. Each part stands in the cells of the grid
    that its surroundings touch and meets the parts that start in them; spans of
    a kind do not overlap, so a cell holds a bounded number.
    """
    rows = parts.where(F.size("weak") > 0).dropDuplicates(["_id", "_hash"])
    role = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])))
    weak = rows.select("_id", "_hash", F.explode("weak").alias("w")).withColumn(
        "cell", F.explode(F.expr(f"sequence(greatest(0, w.start - 2 * {REACH}) div {REACH}, (w.stop + {REACH}) div {REACH})"))
    )
    every = rows.select("_id", "_hash", F.explode(F.concat("base", "weak")).alias("o"))
    # a part longer than the grid stands in each cell that it crosses
    every = every.withColumn("cell", F.explode(F.expr(f"sequence(o.start div {REACH}, o.stop div {REACH})")))
    a, b = role[F.col("w.kind")], role[F.col("o.kind")]
    near = (F.col("o.start") <= F.col("w.stop") + REACH) & (F.col("w.start") <= F.col("o.stop") + REACH)
    whole = ((a == "i") & (b == "s")) | ((a == "s") & b.isin("i", "e")) | ((a == "e") & (b == "s"))
    met = weak.alias("x").join(
        every.alias("y"),
        F.col("x._id").eqNullSafe(F.col("y._id")) & (F.col("x._hash") == F.col("y._hash")) & (F.col("x.cell") == F.col("y.cell"))
        & near & whole,
        "left_semi",
    )
    return met.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("w")).alias("linked"))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def _number(kind: int) -> Column:
    """How many base spans are of the kind; a filter with a second parameter would be given the place of a span."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text hash, base, linked`` of each row: strong spans and linked weak ones.

    Null and empty texts have no spans. Rows with equal key and text have equal
    results, and each of them stays. Other columns are ignored.
    """
    parts = settle(
        _identified(documents.select(key, text), key, text).select("_id", "_hash", F.col(text).alias("_text"))
        .mapInArrow(_parts("_text"), f"_id {documents.schema[key].dataType.simpleString()}, _hash string, base array<{SPAN}>, weak array<{SPAN}>"),
        "secret-parts",
    )
    weak = linked_weak(parts).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "linked")
    return parts.join(
        weak, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left"
    ).select("_id", "_hash", "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``documents`` with every reported span of the text replaced by ``mark``.

    All rows and columns stay; a null text stays null.
    """
    found = settle(
        scan(documents, key, text).where("size(base) + size(linked) > 0").dropDuplicates(["_id", "_hash"])
        .select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), F.array_sort(F.concat("base", "linked")).alias("_spans")),
        "secret-spans",
    )
    named = _identified(documents, key, text)
    joined = named.join(
        broadcast_if_small(found, 512, 64 << 20), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left"
    ).select(*documents.columns, "_spans")
    pieces = F.aggregate(
        "_spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["stop"] <= s["at"], s).otherwise(F.struct(
            x["stop"].alias("at"),
            F.concat(s["out"], F.array(F.when(
                x["start"] >= s["at"],
                F.concat(F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)),
            ).otherwise(F.lit("")))).alias("out"),
        )),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(pieces)).drop("_spans")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every document."""
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(
        F.col("_id").alias("doc_id"), *(_number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
