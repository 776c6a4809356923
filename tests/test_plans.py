import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from versetide.operators.events import clean_log
from versetide.plans.oracle import ORACLE
from versetide.plans.offline import offline_job, user_log
from versetide.plans.queries import QUERIES
from versetide.plans.roles import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
ARROW = {"factors_top", "als_step", "daily_factors", "recall_with_factors", "similar_given", "word_vectors_exact", "impression_loop", "recall_with_cf", "guess_strangers", "similar_exact", "similar_text", "most_similar", "recall_candidates", "guess_you_like", "guess_by_star", "cf_topk"}
MODELS = {"similar_text", "cf_topk", "daily_factors", "recall_with_factors", "ranker_compare", "guess_you_like"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_queries_run_without_crosses_or_row_udfs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in ARROW:
        assert "InArrow" not in text and "InPandas" not in text
    df.write.format("noop").mode("overwrite").save()


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(ORACLE) == MODELS
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    Tables(spark, FOLDER).access_log().write.parquet(path)
    text = plan(clean_log(spark.read.parquet(path)))
    assert "Not(StringStartsWith(url,search))" in text.replace(" ", "")
    scan = text[text.index("ReadSchema"):]
    assert "logId" not in scan and "visitTime" not in scan
    assert text.count("FileScan") == 1


def test_ratings_move_partial_sums_only(spark):
    text = plan(user_log(Tables(spark, FOLDER).access_log()))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_offline_job_keeps_actions_apart_from_samples(spark):
    from versetide.operators.features import feature_vocab, one_hot_table

    t = Tables(spark, FOLDER)
    result = offline_job(t.access_log(), t.users(), one_hot_table(t.items(), feature_vocab(t.items())),
                         t.favourites(), t.impressions())
    assert result.actions.count() < result.samples.count()
    zero = result.samples.join(result.actions, ["userId", "itemId"], "left_anti").where(F.col("itemId").isNotNull())
    assert {(r["rating"], r["label"]) for r in zero.select("rating", "label").distinct().collect()} == {(0, 0)}
    assert "collectAuthor" in result.training.columns and result.training.count() > 0


def test_factorisation_trains_on_actions_alone(spark, tmp_path):
    from versetide.operators import cf

    t = Tables(spark, FOLDER)
    model = cf.fit_cf(user_log(t.access_log()), rank=3, max_iter=3)
    best = cf.recommend_all(model, 5)
    cf.save_cf_lists(best, str(tmp_path / "lists"))
    stored = spark.read.parquet(str(tmp_path / "lists"))
    assert stored.groupBy("userId").count().where("count <> 5").count() == 0
    acting = cf.known_ratings(user_log(t.access_log())).select("userId").distinct().count()
    assert stored.select("userId").distinct().count() == acting
