"""Named queries over one directory of tables, each on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.operators import als, cf, ranker, text, words
from versetide.operators.events import clean_log, engagement_ratings, parse_report, score_events
from versetide.operators.features import (
    feature_vocab,
    join_items,
    item_indicators,
    one_hot_table,
    ranker_rows,
    sparse_training_set,
    term_table,
    training_set,
)
from versetide.operators.metrics import ranker_metrics
from versetide.operators.ranking import sample_rows
from versetide.operators.recall import (
    parse_activity,
    recall,
    recent_activity,
    tag_index,
    tag_lists,
)
from versetide.operators.samples import add_negatives, label_balance, lists_wanted
from versetide.plans.offline import offline_job, user_log
from versetide.plans.roles import DEFAULTS, Tables
from versetide.plans.serve import (
    daily_for,
    daily_list,
    guess_you_like,
    most_similar,
    shown_lists,
)
from versetide.session import scratch_path, settle
from versetide.sources.batch import read_csv, read_log_lines
from versetide.sources.sinks import append_impressions, read_impressions, to_payload
from versetide.streaming.headers import parse_envelope, parse_headers
from versetide.streaming.jobs import (
    append_events,
    read_event_stream,
    read_recent,
    recent_activity_stream,
)

SEED = 42
DAY = "2024-02-01"
LIST = 100
FIXED = 10
# 10 iterations and 0.6 came out best at ranks 20 and 100 on purchases of sf0.001; the larger rank gained nothing.
FACTORS = {"rank": 20, "max_iter": 10, "reg": 0.6}


def _round(column: str, digits: int = 4):
    return F.round(F.col(column), digits).alias(column)


def _log(t: Tables) -> DataFrame:
    return settle(user_log(t.access_log()), "user-log")


def _shown(t: Tables) -> DataFrame:
    return settle(t.impressions(), "impressions")


def _samples(t: Tables) -> DataFrame:
    return add_negatives(_log(t), _shown(t), seed=SEED)


def _similar(t: Tables) -> DataFrame:
    return settle(text.similar_items(t.vectors(), LIST), "similar")


def _recent(t: Tables) -> DataFrame:
    return settle(recent_activity(t.actions(), t.items()), "recent")


def _index(t: Tables) -> DataFrame:
    return settle(tag_index(t.items(), SEED), "tag-index")


def _ratings(t: Tables) -> DataFrame:
    return settle(cf.known_ratings(t.purchases()), "ratings")


def _users(t: Tables) -> DataFrame:
    return t.users().select("userId")


def access_log_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_log(Tables(spark, folder).access_log())


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_events(clean_log(Tables(spark, folder).access_log()))


def engagement(spark: SparkSession, folder: str) -> DataFrame:
    return engagement_ratings(score_events(clean_log(Tables(spark, folder).access_log())))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return label_balance(user_log(Tables(spark, folder).access_log()))


def parse_failures(spark: SparkSession, folder: str) -> DataFrame:
    return parse_report(clean_log(Tables(spark, folder).access_log()))


def impression_sample(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    store = _shown(t)
    drawn = sample_rows(store, "impressionId", lists_wanted(_log(t)), SEED)
    return drawn.select("impressionId", "userId", F.explode("items").alias("itemId"))


def negatives_added(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(Tables(spark, folder))


def items_joined(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return join_items(user_log(t.access_log()), t.items().drop("poemTagNames"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    wide = one_hot_table(t.items(), feature_vocab(t.items()))
    return training_set(_samples(t), wide, t.users(), t.favourites(), keep_ids=True)


def multi_hot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Set indicators as (poemId, term, value) rows, by way of the term ids."""
    items = Tables(spark, folder).items()
    terms = term_table(items)
    ids = item_indicators(items, terms).select("poemId", F.explode("indicators").alias("termId"))
    return ids.join(terms, "termId").select("poemId", "term", F.lit(1.0).alias("value"))


def training_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows with term ids, shown as one text."""
    t = Tables(spark, folder)
    rows = sparse_training_set(_samples(t), t.items(), t.users(), t.favourites(), term_table(t.items()))
    return rows.withColumn("indicators", F.array_join(F.transform("indicators", lambda i: i.cast("string")), " "))


def tag_index_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tag_index(Tables(spark, folder).items(), SEED)


def tag_list_sizes(spark: SparkSession, folder: str) -> DataFrame:
    lists = tag_lists(tag_index(Tables(spark, folder).items(), SEED))
    return lists.select("tag", "chunk", "n", F.posexplode("items").alias("place", "itemId"))


def recent_entries(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    parsed = parse_activity(recent_activity(t.actions(), t.items()))
    return parsed.select("userId", "pos", "itemId", F.array_join("tags", "-").alias("tags"))


def recall_candidates(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return recall(_users(t), _recent(t), _similar(t), _index(t), DEFAULTS, SEED)


def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    cut = text.token_table(Tables(spark, folder).documents())
    return text.tf_idf(cut, cut.count()).select("docId", "term", "tf", "df", _round("weight"))


def similar_exact(spark: SparkSession, folder: str) -> DataFrame:
    near = _similar(Tables(spark, folder))
    pairs = F.posexplode(F.arrays_zip("top100", "scores")).alias("place", "e")
    return near.select("poemId", pairs).select(
        "poemId", (F.col("place") + 1).alias("rank"), F.col("e.top100").alias("similarId"),
        F.round(F.col("e.scores") * 1_000_000).cast("bigint").alias("micros"),
    )


def similar_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents()
    return text.similar_items(text.text_vectors(docs), LIST).select(
        "poemId", F.posexplode("top100").alias("place", "similarId")
    )


def most_similar_items(spark: SparkSession, folder: str) -> DataFrame:
    return to_payload(most_similar(_similar(Tables(spark, folder)))).select("poemId", "payload")


def cf_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ratings(Tables(spark, folder))
    biased = cf.fit_biases(rows).add(rows)
    return biased.select("userId", "itemId", F.round(cf.clip(F.col("base")), 4).alias("prediction"))


def cf_baseline_top(spark: SparkSession, folder: str) -> DataFrame:
    biases = cf.fit_biases(_ratings(Tables(spark, folder)))
    return cf.baseline_top(biases, LIST).select("userId", "itemId", "rank", _round("score"))


def cf_topk(spark: SparkSession, folder: str) -> DataFrame:
    model = cf.fit_cf(Tables(spark, folder).purchases(), rank=20, max_iter=10)
    return cf.recommend_all(model, LIST)


def als_step(spark: SparkSession, folder: str) -> DataFrame:
    """One half-step from given item vectors: each user's two factors, in millionths."""
    rows = _ratings(Tables(spark, folder)).select("userId", "itemId", F.array("rating").alias("values"), F.lit(0).alias("fold"))
    by_user = als.blocks(settle(rows, "rated"), "userId", "itemId")
    given = settle(als.first_vectors(rows.select("itemId").distinct(), "itemId", 2), "given-vectors")
    users = als.half_step(by_user, given, 2, [als.Setting(0.1)])
    places = users.select(F.col("id").alias("userId"), F.posexplode("vec").alias("place", "value"))
    return places.select("userId", "place", F.round(F.col("value") * 1_000_000).cast("bigint").alias("micros"))


def _factor_lists(t: Tables) -> DataFrame:
    """Stored lists of the factor model of the log without negatives."""
    path = scratch_path(t.spark, "factor-lists")
    model = cf.fit_sums(_log(t), FACTORS["rank"], FACTORS["max_iter"], FACTORS["reg"])
    cf.save_cf_lists(cf.recommend_all(model, LIST), path)
    return t.spark.read.parquet(path)


def daily_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The daily list from the factor model's stored lists."""
    t = Tables(spark, folder)
    daily = shown_lists(daily_list(_factor_lists(t), DAY))
    return to_payload(daily_for(_users(t), daily), "rijian").select("userId", "payload")


def recall_with_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Recall with the factor model's stored lists as the fixed set."""
    t = Tables(spark, folder)
    stored = _factor_lists(t).where(F.col("rank") <= FIXED)
    return recall(_users(t), _recent(t), _similar(t), _index(t), DEFAULTS, SEED, fixed=stored)


def offline_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The offline job from the access log to training rows."""
    t = Tables(spark, folder)
    wide = one_hot_table(t.items(), feature_vocab(t.items()))
    return offline_job(t.access_log(), t.users(), wide, t.favourites(), _shown(t), seed=SEED).training


def fold_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = cf.fold_errors(Tables(spark, folder).purchases())
    return errors.select("fold", "n", _round("rmse", 6), _round("mae", 6))


def factors_top(spark: SparkSession, folder: str) -> DataFrame:
    """Lists from given factors: the halves of ``vectors`` are those of users and of items."""
    both = settle(Tables(spark, folder).vectors().select("id", F.col("vec").cast("array<double>").alias("vec")), "factors")
    half = (F.size("vec") / 2).cast("int")
    users = both.select(F.col("id").alias("userId"), (F.col("id") % 5 / 10).alias("userBias"), F.slice("vec", F.lit(1), half).alias("p"))
    items = both.select(F.col("id").alias("itemId"), (F.col("id") % 7 / 10).alias("itemBias"), F.slice("vec", half + 1, half).alias("q"))
    best = cf.recommend_all(cf.CFModel(1.5, users, items), 20)
    return best.select("userId", "itemId", "rank", F.round(F.col("score") * 1_000_000).cast("bigint").alias("micros"))


def word_vectors_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the counted word vectors at their places, in whole units."""
    sums = words.word_sums(text.token_table(Tables(spark, folder).documents()))
    places = sums.select("term", F.posexplode("sums").alias("place", "units"))
    return places.where("units <> 0")


def _given_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Document vectors from word vectors that are made from a hash of the word."""
    cut = text.token_table(Tables(spark, folder).documents())
    parts = [F.conv(F.substring(F.md5("term"), 2 * i + 1, 2), 16, 10) / 255 - 0.5 for i in range(8)]
    terms = cut.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    return text.doc_vectors(cut, terms.select("term", F.array(*parts).alias("vector")), cut.count())


def doc_vectors_given(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors in whole units of their eighth place."""
    vectors = _given_vectors(spark, folder)
    places = vectors.select("docId", F.posexplode("vec").alias("place", "value"))
    return places.select("docId", "place", F.round(F.col("value") * text.VALUE_UNIT).cast("bigint").alias("units"))


def similar_given(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar documents by the given vectors."""
    vectors = _given_vectors(spark, folder).withColumnRenamed("docId", "id")
    near = text.similar_items(settle(vectors, "given-vectors"), LIST)
    return near.select("poemId", F.posexplode(F.arrays_zip("top100", "scores")).alias("place", "e")).select(
        "poemId", (F.col("place") + 1).alias("rank"), F.col("e.top100").alias("similarId"),
        F.round(F.col("e.scores") * 1_000_000).cast("bigint").alias("micros"),
    )


def recall_with_cf(spark: SparkSession, folder: str) -> DataFrame:
    """Recall with the bias model's stored lists as the fixed set."""
    t = Tables(spark, folder)
    path = scratch_path(spark, "cf-lists")
    cf.save_cf_lists(cf.baseline_top(cf.fit_biases(_ratings(t)), LIST), path)
    stored = spark.read.parquet(path).where(F.col("rank") <= FIXED)
    return recall(_users(t), _recent(t), _similar(t), _index(t), DEFAULTS, SEED, fixed=stored)


def _ranker_inputs(t: Tables):
    rows = ranker_rows(_samples(t), t.items(), t.users(), t.favourites())
    return rows, ranker.ranker_terms(t.items(), t.users())


def ranker_features(spark: SparkSession, folder: str) -> DataFrame:
    """What is not zero in the feature row of each sample."""
    arrays = ranker.feature_arrays(*_ranker_inputs(Tables(spark, folder)))
    cells = arrays.select("userId", "itemId", F.explode(F.arrays_zip("places", "values")).alias("c"))
    return cells.select("userId", "itemId", F.col("c.places").alias("place"), F.col("c.values").alias("value")).where("value <> 0")


# Trees that are given: by star and favourite flag, and by two terms and star.
GIVEN_TREES = [(0, 25.0, (1, 0.5, None, None), (0, 40.0, None, None)), (5, 0.5, (0, 10.0, None, (9, 0.5, None, None)), None)]


def leaf_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The leaves that each sample reaches in the given trees."""
    arrays = ranker.feature_arrays(*_ranker_inputs(Tables(spark, folder)))
    return ranker.leaf_slots(arrays, GIVEN_TREES, 8).select("userId", "itemId", F.explode("slots").alias("slot"))


def ranker_compare(spark: SparkSession, folder: str) -> DataFrame:
    return ranker.compare_rankers(*_ranker_inputs(Tables(spark, folder)))


def guess(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and ranking with trees and factorisation machine; the lists are logged as shown."""
    t = Tables(spark, folder)
    rows, terms = _ranker_inputs(t)
    model = ranker.fit_ranker(rows, "trees+fm", terms)
    ranked = settle(
        guess_you_like(
            _users(t), _recent(t), _similar(t), _index(t), t.items(), t.users(),
            t.favourites(), model, DEFAULTS, seed=SEED,
        ),
        "ranked",
    )
    lists = shown_lists(ranked)
    append_impressions(lists, scratch_path(spark, "impressions"), DAY)
    return to_payload(lists, "rs").select("userId", "payload")


class _ByStar:
    """Ranks by the item's star, for a ranking that SQL can repeat."""

    @staticmethod
    def transform(rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.col("poemStar") + 100 * F.col("collectAuthor"))


def guess_by_star(spark: SparkSession, folder: str) -> DataFrame:
    """The same service with a ranker of two terms: star, and a favourite author first."""
    t = Tables(spark, folder)
    ranked = guess_you_like(
        _users(t), _recent(t), _similar(t), _index(t), t.items(), t.users(),
        t.favourites(), _ByStar, DEFAULTS, seed=SEED,
    )
    return to_payload(shown_lists(ranked), "rs").select("userId", "payload")


def star_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Area and loss of the ranking by star and favourite author, on all samples, for each sex."""
    t = Tables(spark, folder)
    rows = ranker_rows(_samples(t), t.items(), t.users(), t.favourites())
    scored = _ByStar.transform(rows).select("userSex", "label", (F.col("score") / 150).alias("score"))
    found = ranker_metrics(scored, "userSex")
    return found.select("userSex", "n", "positives", _round("auc", 6), _round("logloss", 6))


def impression_loop(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of ``guess_by_star`` are logged as shown and come back as negatives."""
    t = Tables(spark, folder)
    ranked = guess_you_like(
        _users(t), _recent(t), _similar(t), _index(t), t.items(), t.users(),
        t.favourites(), _ByStar, DEFAULTS, seed=SEED,
    )
    store = scratch_path(spark, "impressions")
    append_impressions(shown_lists(ranked), store, DAY, "r1")
    return add_negatives(_log(t), read_impressions(spark, store), seed=SEED)


def guess_strangers(spark: SparkSession, folder: str) -> DataFrame:
    """The same service where user info and authors are missing for some, and items stand twice."""
    t = Tables(spark, folder)
    items = t.items().withColumn("poemAuthorId", F.when(F.col("poemStar") % 2 == 0, F.col("poemAuthorId")))
    ranked = guess_you_like(
        _users(t), _recent(t), _similar(t), _index(t), items.unionByName(items), t.users().where("userSex <> 'BUILDING'"),
        t.favourites(), _ByStar, DEFAULTS, seed=SEED,
    )
    return to_payload(shown_lists(ranked), "rs").select("userId", "payload")


def daily_lists(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    biases = cf.fit_biases(_ratings(t))
    daily = shown_lists(daily_list(cf.baseline_top(biases, LIST), DAY))
    return to_payload(daily_for(_users(t), daily), "rijian").select("userId", "payload")


def headers_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_headers(Tables(spark, folder).header_texts())


def envelopes_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_headers(parse_envelope(Tables(spark, folder).envelopes()))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "log-lines")
    Tables(spark, folder).log_lines().write.text(path)
    return read_log_lines(spark, path, "eventId bigint, userId bigint, action string")


def csv_items(spark: SparkSession, folder: str) -> DataFrame:
    """The one-hot table by way of a CSV with header."""
    items = Tables(spark, folder).items()
    path = scratch_path(spark, "one-hot-csv")
    wide = one_hot_table(items, feature_vocab(items))
    wide.write.option("header", True).csv(path)
    return join_items(user_log(Tables(spark, folder).access_log()), read_csv(spark, path, wide.schema)).drop("poemId")


def stream_recent(spark: SparkSession, folder: str) -> DataFrame:
    """Activity as a stream of files, kept as the last actions of each user."""
    t = Tables(spark, folder)
    source, store = scratch_path(spark, "actions"), scratch_path(spark, "recent")
    t.actions().write.parquet(source)
    stream = read_event_stream(
        spark, source, "userId bigint, eventId bigint, ts timestamp, itemId int", "parquet", files_per_batch=2
    )
    recent_activity_stream(stream, store, scratch_path(spark, "recent-state"), once=True).awaitTermination()
    parsed = parse_activity(read_recent(spark, store, items=t.items()))
    return parsed.select("userId", "pos", "itemId", F.array_join("tags", "-").alias("tags"))


def stream_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header texts as a stream of JSON files, parsed and appended to a log table."""
    source, log = scratch_path(spark, "headers"), scratch_path(spark, "click-log")
    Tables(spark, folder).header_texts().write.json(source)
    stream = parse_headers(read_event_stream(spark, source, "eventId bigint, headers string"))
    append_events(stream, log, scratch_path(spark, "click-state"), once=True).awaitTermination()
    return spark.read.parquet(log)


QUERIES = {
    "access_log_clean": access_log_clean,
    "event_scores": event_scores,
    "engagement_ratings": engagement,
    "label_balance": labels,
    "parse_report": parse_failures,
    "impression_sample": impression_sample,
    "negatives_added": negatives_added,
    "items_joined": items_joined,
    "training_set": training_rows,
    "training_sparse": training_sparse,
    "multi_hot": multi_hot_rows,
    "tag_index": tag_index_rows,
    "tag_lists": tag_list_sizes,
    "recent_activity": recent_entries,
    "recall_candidates": recall_candidates,
    "tfidf_weights": tfidf_weights,
    "similar_exact": similar_exact,
    "similar_text": similar_text,
    "most_similar": most_similar_items,
    "cf_baseline": cf_baseline,
    "cf_baseline_top": cf_baseline_top,
    "cf_topk": cf_topk,
    "als_step": als_step,
    "daily_factors": daily_factors,
    "recall_with_factors": recall_with_factors,
    "offline_job": offline_rows,
    "fold_errors": fold_errors,
    "factors_top": factors_top,
    "doc_vectors_given": doc_vectors_given,
    "similar_given": similar_given,
    "word_vectors_exact": word_vectors_exact,
    "recall_with_cf": recall_with_cf,
    "guess_strangers": guess_strangers,
    "impression_loop": impression_loop,
    "ranker_metrics": star_metrics,
    "ranker_features": ranker_features,
    "leaf_slots": leaf_slots,
    "ranker_compare": ranker_compare,
    "guess_you_like": guess,
    "guess_by_star": guess_by_star,
    "daily_list": daily_lists,
    "headers_parsed": headers_parsed,
    "envelopes_parsed": envelopes_parsed,
    "log_lines": log_lines,
    "csv_items": csv_items,
    "stream_recent": stream_recent,
    "stream_headers": stream_headers,
}
