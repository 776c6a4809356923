"""Quality rules: n-gram likelihood ratio between a trusted part and the whole corpus.

Bigrams of tokens (words, and runs of punctuation) are hashed into a fixed number of slots. Counts per slot over all
documents and over the trusted ones give two multinomials; a document's score is
the mean log ratio of its bigrams. Ratios are kept as whole micro-nats, so sums
are exact and every document is judged alike on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.session import broadcast_if_small, settle

#: White space between words, symbols that are counted, base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words

#: A word, or a run of other visible characters, so that marks glued to words count by themselves.
TOKEN = r"[\p{L}\p{N}_]+|[^\x09-\x0D\x20\p{L}\p{N}_]+"
#: Slots of the hash, four hexadecimal digits of md5.
SLOTS = 1 << 16
#: Least mean log ratio of a kept document, in micro-nats per bigram.
THRESHOLD = -130_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def slot_of(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 4), 16, 10).cast("int")


def _positions(words: Column, width: int) -> Column:
    """First positions of all windows of ``width`` words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(
        F.array().cast("array<int>")
    )


def repeated_words(words: str) -> tuple[Column, Column, Column]:
    """Three steps: 3-word windows, those that occur twice, words they cover.

    A window is held as its 64-bit hash. Only a text in which one comes back is
    sorted: equal windows then lie side by side, so a long text costs a sort and
    no pairs.
    """
    w = F.col(words)
    hashed = F.transform(_positions(w, 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = F.col("ordered")
    twice = F.filter(rows, lambda x, k: F.coalesce(
        (F.get(rows, k - 1)["h"] == x["h"]) | (F.get(rows, k + 1)["h"] == x["h"]), F.lit(False)
    ))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
    ))))
    return hashed, ordered, F.when(rows.isNull(), 0).otherwise(covered)


def text_features(documents: DataFrame, text: str = "text") -> DataFrame:
    """Base counts and bigram slots of each row; the text itself is dropped.

    A null text has no words. Columns of ``documents`` with the names of the
    counts are replaced.
    """
    windows, ordered, covered = repeated_words("words")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(f"[^{SPACE[1:-2]}]"))
    return (
        documents.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).drop(text)
        .withColumns({
            "words": words_of(F.col("_text")), "lines": lines, "tokens": F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0)),
        })
        .withColumns({
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": symbol_count(F.col("_text")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": windows,
        })
        .withColumn("ordered", ordered)
        .withColumns({
            "n_repeat_words": covered.cast("long"),
            "slots": F.transform(
                _positions(F.col("tokens"), 2),
                lambda i: slot_of(F.concat_ws(" ", F.get("tokens", i), F.get("tokens", i + 1))),
            ),
        })
        .drop("_text", "words", "tokens", "lines", "windows", "ordered")
    )


def log_ratios(features: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """``slot, ratio``: micro-nats of trusted against raw share, add-one smoothed.

    Counts cover every row of ``features``; sums are made before the shuffle, so
    it moves at most one row for each slot and task.
    """
    marks = settle(trusted.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), "trusted")
    marked = features.select(key, "slots").join(
        broadcast_if_small(marks, 16).withColumn("is_trusted", F.lit(1)), key, "left"
    )
    counts = marked.select(
        F.explode("slots").alias("slot"), F.coalesce("is_trusted", F.lit(0)).alias("is_trusted")
    ).groupBy("slot").agg(F.sum("is_trusted").alias("good"), F.count("*").alias("raw"))
    counts = settle(counts, "slot-counts")
    total = counts.agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).first()
    if not total["good"]:
        return counts.select("slot", F.lit(0).cast("long").alias("ratio"))  # nothing to compare with
    good, raw = (total["good"] or 0) + SLOTS, (total["raw"] or 0) + SLOTS
    share = F.log((F.col("good") + 1) / F.lit(float(good))) - F.log((F.col("raw") + 1) / F.lit(float(raw)))
    return counts.select("slot", F.round(share * 1e6).cast("long").alias("ratio"))


def judge_quality(
    documents: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """``documents`` without the text, with base counts, score and verdict of each row.

    ``base_failed`` follows the base rules; ``kept`` is false for those, else
    true when the mean ratio reaches ``threshold``. ``score`` is the sum of the
    micro-nats over ``n_grams`` bigrams. ``trusted`` holds the keys of the target
    documents; repeated or unknown keys there change nothing, and without any the
    ratios are zero and all that pass the base rules stay. Repeated rows are
    judged each.

    The ratios are a table of ``SLOTS`` rows whatever the corpus, small enough to
    stand in the plan as an array.
    """
    features = settle(text_features(documents, text), "features")
    known = {r["slot"]: r["ratio"] for r in log_ratios(features, trusted, key).collect()}  # SLOTS rows at most
    table = F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(SLOTS))), ",").cast("array<bigint>")
    score = F.aggregate("slots", F.lit(0).cast("long"), lambda total, slot: total + F.get(table, slot))
    judged = features.withColumns({
        "n_grams": F.size("slots").cast("long"), "score": score,
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    }).drop("slots")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("n_grams") * threshold))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document against those labelled good."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    return judge_quality(documents, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "score", "n_grams",
    )


ORACLE = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
),
places AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM split),
token_places AS (
  SELECT doc_id, k, unnest(range(1, len(k))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{TOKEN}') AS k FROM texts)
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places WHERE i + 2 <= len(w)
),
covered AS (
  SELECT doc_id, count(DISTINCT i + o.d) AS n FROM windows, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY doc_id
),
slots AS (SELECT doc_id, ('0x' || md5(k[i] || ' ' || k[i + 1])[1:4])::INT AS slot FROM token_places),
counts AS (
  SELECT slot, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good
  FROM slots GROUP BY slot
),
ratios AS (
  SELECT slot, round((ln((good + 1) / (sum(good) OVER () + {SLOTS})) - ln((raw + 1) / (sum(raw) OVER () + {SLOTS}))) * 1e6)::BIGINT AS ratio
  FROM counts
),
scores AS (SELECT doc_id, sum(ratio)::BIGINT AS score, count(*) AS n_grams FROM slots JOIN ratios USING (slot) GROUP BY doc_id),
base AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(score, 0)::BIGINT AS score, coalesce(n_grams, 0)::BIGINT AS n_grams
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN scores USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND score >= n_grams * ({THRESHOLD}) AS kept
FROM base
"""
