"""Language identification by Bayesian fusion of evidence.

The likelihood of a text under each language comes from hashed letter trigrams,
counted over all rows that declare a language. Declared language and address
suffix count by how often they go with a language in the whole table, as judged
by the text alone. The prior of a host is smoothed towards its domain's, and
that one towards the table's. All of these are grouped sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.llm import arrays as A
from versetide.llm.url_rules import split_url
from versetide.session import broadcast_if_small, settle

SLOTS = 1 << 15
#: Fewest rows that make the value they declare a language, whatever other rows there are.
FEWEST = 5
#: Bytes of trigram tables that a task holds; more languages take one more pass for each block.
TABLE_BYTES = 32 << 20
#: Scores that are worked on at once.
CELLS = 1 << 20
#: Each letter is in three trigrams, so a text's log likelihood counts a third.
OVERLAP = 3.0
#: Rows that the level above is worth when a host's or domain's counts are smoothed.
WEIGHT = 20.0
#: Log odds against a text being letters at random.
SENSE = 10.0
#: Least posterior of an accepted language.
SURE = 0.5

_FOLD = np.zeros(256, np.uint64)  # letters of ASCII in lower case, bytes of other characters, all else a gap
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:256] = np.arange(27, 155)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of each trigram with a letter in it; a row begins and ends with its text."""
    rows = len(bounds) - 1
    own = np.repeat(np.arange(rows), np.diff(bounds))
    fold = np.zeros(len(data) + 2 * rows, np.uint64)  # a gap before and after each text
    fold[np.arange(len(data)) + 2 * own + 1] = _FOLD[data]
    n = max(0, len(fold) - 2)
    code = (fold[:n] << np.uint64(16)) | (fold[1 : n + 1] << np.uint64(8)) | fold[2 : n + 2]
    ends = bounds + 2 * np.arange(rows + 1)
    place = np.arange(n)
    row = np.searchsorted(ends, place, "right") - 1
    fine = (code > 0) & (place + 3 <= ends[np.minimum(row + 1, rows)]) if n else np.zeros(0, bool)
    return (A.mix(code[fine]) >> np.uint64(64 - 15)).astype(np.int64), row[fine]


def likelihoods(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each row under each language, and its number of trigrams."""
    slot, row = trigrams(data, bounds)
    rows = len(bounds) - 1
    ends = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros((rows, len(table)))
    for k, one in enumerate(table):
        total = np.r_[0.0, np.cumsum(one[slot])]
        out[:, k] = total[ends[1:]] - total[ends[:-1]]
    return out, np.diff(ends)


def _counter(text: str, names: list[str], first: int):
    def count(batches):
        number = {v: k for k, v in enumerate(names)}
        total = np.zeros((len(names), SLOTS), np.int64)
        for batch in batches:
            for part in A.slices(batch, text):
                slot, row = trigrams(*A.raw(part.column(text)))
                who = np.array([number.get(v, -1) for v in part.column("declared").to_pylist()], np.int64)[row]
                known = who >= 0
                total += np.bincount(who[known] * SLOTS + slot[known], minlength=total.size).reshape(total.shape)
        for k in range(len(names)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int32()), A.lists(total[k], np.array([SLOTS]), pa.int64())], ["language", "counts"]
            )

    return count


def _scores(part: pa.RecordBatch, text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the rows under the languages of earlier passes and of ``table``, and numbers of trigrams."""
    score, n = likelihoods(*A.raw(part.column(text)), table)
    if "_scores" in part.schema.names:
        score = np.hstack([_flat(part.column("_scores"))[0].reshape(len(part), -1), score])
    return score, n


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls among them, and how many each row has."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def _parts(batch: pa.RecordBatch, text: str, languages: int):
    step = max(1, CELLS // languages)
    for part in A.slices(batch, text):
        for start in range(0, len(part), step):
            yield part.slice(start, step)


def _scorer(text: str, table: np.ndarray):
    def score(batches):
        for batch in batches:
            for part in _parts(batch, text, len(table)):
                out, _ = _scores(part, text, table)
                names = [c for c in part.schema.names if c != "_scores"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), A.lists(out.ravel(), np.full(len(out), out.shape[1]), pa.float64())],
                    [*names, "_scores"],
                )

    return score


def _guesser(text: str, table: np.ndarray, languages: int):
    """The likeliest language by the text alone; none for a text without letters."""
    def guess(batches):
        for batch in batches:
            for part in _parts(batch, text, languages):
                score, n = _scores(part, text, table)
                best = score.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("declared", "suffix", "host", "domain")),
                     pa.array(best, pa.int32(), mask=n == 0)],
                    ["declared", "suffix", "host", "domain", "guess"],
                )

    return guess


#: Columns that the last step reads and drops.
ADDED = {"_scores", *(f"_{kind}_{part}" for kind in ("above", "host", "declared", "suffix") for part in ("which", "often"))}


class Model:
    """Languages, their trigram counts, the tables of evidence, and guesses of each language.

    An evidence table has for each value the languages it goes with and how often,
    and only those, so its size does not depend on the number of languages.
    """

    def __init__(self, names: list[str], counts: DataFrame | None, evidence: dict[str, DataFrame], of: np.ndarray, spread: dict[str, int]):
        self.names, self.counts, self.evidence, self.of, self.spread = names, counts, evidence, of, spread


def blocks_of(languages: int) -> list[tuple[int, int]]:
    """Ranges of languages whose tables fit TABLE_BYTES."""
    step = max(1, TABLE_BYTES // (8 * SLOTS))
    return [(i, min(i + step, languages)) for i in range(0, languages, step)]


def _table(counts: DataFrame, start: int, stop: int) -> np.ndarray:
    """Log probability of each trigram under the languages from ``start`` to ``stop``."""
    summed = counts.where((F.col("language") >= start) & (F.col("language") < stop)).toPandas()  # SLOTS rows for each at most
    count = np.zeros((stop - start, SLOTS))
    count[summed["language"] - start, summed["slot"]] = summed["n"]
    return np.log((count + 0.5) / (count.sum(1, keepdims=True) + 0.5 * SLOTS))


def _scored(rows: DataFrame, text: str, counts: DataFrame, languages: int) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with the scores of all blocks of languages but the last, and the table of that one."""
    *others, last = blocks_of(languages)
    for start, stop in others:
        names = [f for f in rows.schema if f.name != "_scores"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), "_scores array<double>"])
        rows = settle(rows.mapInArrow(_scorer(text, _table(counts, start, stop)), schema), "scores")
    return rows, _table(counts, *last)


def fit(rows: DataFrame) -> Model:
    """Model of ``rows`` with columns text, declared, suffix, host and domain.

    Nulls carry no evidence. Values that fewer than FEWEST rows declare are no
    languages, but count as evidence like others.
    """
    declaring = settle(rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n")), "declared")
    names = sorted(r[0] for r in declaring.where(F.col("n") >= FEWEST).collect())
    if not names:
        return Model([], None, {}, np.zeros(0), {})
    counted = None
    for start, stop in blocks_of(len(names)):
        some = names[start:stop]
        part = rows.where(F.col("declared").isin(some)).select("text", "declared").mapInArrow(
            _counter("text", some, start), "language int, counts array<long>"
        )
        part = settle(
            part.select("language", F.posexplode("counts").alias("slot", "n")).where("n > 0")
            .groupBy("language", "slot").agg(F.sum("n").alias("n")),
            "trigrams",
        )
        counted = part if counted is None else counted.unionByName(part)
    ready, table = _scored(rows, "text", counted, len(names))
    guessed = settle(
        ready.mapInArrow(
            _guesser("text", table, len(names)), "declared string, suffix string, host string, domain string, guess int"
        ).where("guess IS NOT NULL").groupBy("declared", "suffix", "host", "domain", "guess").agg(F.count("*").alias("n")),
        "guessed",
    )
    of = np.zeros(len(names))
    for k, n in guessed.groupBy("guess").agg(F.sum("n")).collect():
        of[k] = n

    def by(column: str, carry: tuple[str, ...] = ()) -> DataFrame:  # one entry for each language a value goes with
        sums = guessed.where(F.col(column).isNotNull()).groupBy(column, "guess").agg(
            F.sum("n").alias("n"), *(F.min(c).alias(c) for c in carry)
        )
        return sums.groupBy(column).agg(
            F.collect_list("guess").alias(f"{column}_which"), F.collect_list("n").alias(f"{column}_often"),
            *(F.min(c).alias(c) for c in carry),
        )

    domains = settle(by("domain"), "domain-evidence")
    above = domains.select("domain", F.col("domain_which").alias("above_which"), F.col("domain_often").alias("above_often"))
    tables = {
        "declared": settle(by("declared"), "declared-evidence"), "suffix": settle(by("suffix"), "suffix-evidence"),
        "host": settle(by("host", ("domain",)).join(above, "domain", "left").drop("domain"), "host-evidence"), "domain": domains,
    }
    return Model(names, counted, tables, of, {k: tables[k].count() + 1 for k in ("declared", "suffix")})


def _evidence(part: pa.RecordBatch, of: np.ndarray, spread: dict[str, int]) -> np.ndarray:
    """Log prior and evidence of each row under each language."""
    def dense(column: str) -> np.ndarray:
        which, size = _flat(part.column(f"_{column}_which"))
        often, _ = _flat(part.column(f"_{column}_often"))
        out = np.zeros((len(part), len(of)))
        out[np.repeat(np.arange(len(part)), size), which] = often
        return out

    share = np.broadcast_to((of + 1) / (of.sum() + len(of)), (len(part), len(of)))
    for level in ("above", "host"):  # a value that is not known leaves the level above as it is
        n = dense(level)
        share = (n + WEIGHT * share) / (n.sum(1, keepdims=True) + WEIGHT)
    out = np.log(share)
    for kind, values in spread.items():
        n = dense(kind)
        known = n.sum(1) > 0
        out[known] += np.log((n[known] + 0.5) / (of + 0.5 * values))
    return out


def _fuser(text: str, model_names: list[str], table: np.ndarray, of: np.ndarray, spread: dict[str, int]):
    def fuse(batches):
        uniform = -np.log(SLOTS)
        for batch in batches:
            for part in _parts(batch, text, len(of)):
                score, n = _scores(part, text, table)
                post = score / OVERLAP + _evidence(part, of, spread)
                best = post.argmax(1)
                sure = 1 / np.exp(post - post.max(1, keepdims=True)).sum(1)
                typical = (score[np.arange(len(best)), best] - n * uniform) / OVERLAP > -SENSE
                kept = (n > 0) & typical & (sure >= SURE)
                language = pa.array([model_names[b] for b in best], pa.string(), mask=n == 0)
                names = [c for c in part.schema.names if c not in ADDED]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), language, pa.array(np.where(n > 0, np.round(sure, 6), 0.0)), pa.array(kept)],
                    [*names, "language", "confidence", "kept"],
                )

    return fuse


def identify(
    rows: DataFrame, text: str = "text", declared: Column | None = None, suffix: Column | None = None,
    host: Column | None = None, domain: Column | None = None,
) -> DataFrame:
    """``rows`` with ``language``, ``confidence`` (its posterior) and ``kept``.

    A row is rejected when its text has no letters (null, empty, symbols only), when
    letters at random would explain it better than any language, or when no
    language reaches SURE. Missing evidence of the other kinds leaves a row as it is; a host
    that is not known takes its domain's prior, else the table's. Without any
    declared language there is no model: language is null and nothing is kept. Columns language,
    confidence and kept are replaced, repeated rows are judged each.
    """
    none = F.lit(None).cast("string")
    parts = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}
    rows = rows.drop("language", "confidence", "kept")
    parts = {k: (none if v is None else v).cast("string") for k, v in parts.items()}
    model = fit(rows.select(F.col(text).alias("text"), *(v.alias(k) for k, v in parts.items())))
    if not model.names:
        return rows.withColumns({"language": none, "confidence": F.lit(0.0), "kept": F.lit(False)})
    names = rows.columns
    joined = rows.withColumns({f"_{k}": v for k, v in parts.items()})
    for k, table in model.evidence.items():
        table = table.select(*(F.col(c).alias(f"_{c}") for c in table.columns))
        joined = joined.join(broadcast_if_small(table, 96 + 24 * len(model.names)), f"_{k}", "left")
    host = F.col("_host_which").isNotNull()
    none_of = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    lists = [
        F.coalesce(c, empty).alias(f"_{kind}_{part}")
        for part, empty in zip(("which", "often"), none_of)
        for kind, c in (
            ("above", F.when(host, F.col(f"_above_{part}")).otherwise(F.col(f"_domain_{part}"))),
            *((kind, F.col(f"_{kind}_{part}")) for kind in ("host", "declared", "suffix")),
        )
    ]
    ready, table = _scored(joined.select(*names, *lists), text, model.counts, len(model.names))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["language string", "confidence double", "kept boolean"])
    return ready.mapInArrow(_fuser(text, model.names, table, model.of, model.spread), schema)


def page_evidence() -> dict[str, Column]:
    """Declared language, suffix, host and domain of a row with url and html."""
    host = F.nullif(split_url(F.col("url"))[0], F.lit(""))
    labels = F.split(host, r"\.")
    return {
        "declared": F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]{2,3})", 1)), F.lit("")),
        "suffix": F.element_at(labels, -1), "host": host, "domain": F.array_join(F.slice(labels, -2, 2), "."),
    }


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; its source takes the place of a host."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify(documents, declared=F.col("lang"), host=F.col("source")).drop("text", "source")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page from its text, markup, suffix and host."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    evidence = page_evidence()
    rows = pages.select("page_id", page_text(F.col("html")).alias("text"), *(v.alias(f"page_{k}") for k, v in evidence.items()))
    return identify(rows, **{k: F.col(f"page_{k}") for k in evidence}).select("page_id", "language", "confidence", "kept")
