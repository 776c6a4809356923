import numpy as np
import pytest
from pyspark.sql import functions as F

from versetide.operators import cf


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(60, 2)), rng.normal(size=(50, 2))
    bu, bi = rng.normal(size=60) * 0.3, rng.normal(size=50) * 0.3
    rows = [(1000 + u, i, float(np.clip(1 + bu[u] + bi[i] + p[u] @ q[i], -2, 5)))
            for u in range(60) for i in range(50) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "userId long, itemId long, rating double").cache()


@pytest.fixture(scope="module")
def model(planted):
    return cf.fit_cf(planted, rank=4, max_iter=8, reg=0.05)


def test_biases_by_hand(spark):
    rows = [(1, 1, 3.0), (1, 2, 1.0), (2, 1, 2.0)]
    biases = cf.fit_biases(spark.createDataFrame(rows, "userId long, itemId long, rating double"), 1.0, 2.0)
    items = {r["itemId"]: r["itemBias"] for r in biases.items.collect()}
    users = {r["userId"]: r["userBias"] for r in biases.users.collect()}
    assert biases.mean == 2 and items == pytest.approx({1: 1 / 3, 2: -0.5})
    assert users == pytest.approx({1: (1 - 1 / 3 - 1 + 0.5) / 4, 2: (0 - 1 / 3) / 3})


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2))).first()[0]


def test_model_beats_the_mean_and_the_biases(planted, model):
    mean = rmse(planted.withColumn("prediction", F.lit(planted.agg(F.avg("rating")).first()[0])))
    base = rmse(cf.fit_biases(planted).add(planted).withColumnRenamed("base", "prediction"))
    full = rmse(model.transform(planted))
    assert full < 0.5 * base < base < mean


def test_cold_keys_fall_back(spark, model):
    pairs = spark.createDataFrame([(1, 1), (1000, 999), (1, 999)], "userId long, itemId long")
    rows = {(r["userId"], r["itemId"]): r["prediction"] for r in model.transform(pairs).collect()}
    item = model.items.where("itemId = 1").first()["itemBias"]
    user = model.users.where("userId = 1000").first()["userBias"]
    assert rows == pytest.approx({(1, 1): model.mean + item, (1000, 999): model.mean + user, (1, 999): model.mean})


@pytest.mark.parametrize("blocks", [{}, {"cells": 4, "query_block": 20, "target_block": 10}])
def test_recommend_all_is_the_order_of_the_predictions(spark, model, blocks):
    got = {}
    for r in cf.recommend_all(model, 7, **blocks).orderBy("userId", "rank").collect():
        got.setdefault(r["userId"], []).append((r["itemId"], r["score"]))
    users = {r["userId"]: (r["userBias"], np.array(r["p"])) for r in model.users.collect()}
    items = {r["itemId"]: (r["itemBias"], np.array(r["q"])) for r in model.items.collect()}
    assert got.keys() == users.keys()
    for u, (bu, p) in users.items():
        order = sorted((-round(bi + p @ q, 6), i) for i, (bi, q) in items.items())[:7]
        assert [i for i, _ in got[u]] == [i for _, i in order]
        assert [s for _, s in got[u]] == pytest.approx([min(5, max(-2, model.mean + bu - s)) for s, _ in order], abs=1e-5)


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    back = cf.CFModel.load(spark, str(tmp_path / "m"))
    pairs = model.users.select("userId").limit(5).withColumn("itemId", F.lit(3).cast("bigint"))
    assert sorted(map(tuple, back.transform(pairs).collect())) == sorted(map(tuple, model.transform(pairs).collect()))


def test_wide_ids(spark, planted):
    wide = planted.select((F.col("userId") + 10**12).alias("userId"), (-F.col("itemId") - 5).alias("itemId"), "rating")
    model = cf.fit_cf(wide, rank=4, max_iter=8, reg=0.05)
    assert rmse(model.transform(wide)) < 0.5
    ids = cf.dense_ids(wide, "userId", "u").collect()
    assert sorted(r["u"] for r in ids) == list(range(60))


def test_baseline_top_equals_scoring_every_pair(spark, planted):
    biases = cf.fit_biases(planted)
    users = {r["userId"]: r["userBias"] for r in biases.users.collect()}
    items = sorted((-r["itemBias"], r["itemId"]) for r in biases.items.collect())[:6]
    got = {}
    for r in cf.baseline_top(biases, 6).orderBy("userId", "rank").collect():
        got.setdefault(r["userId"], []).append((r["itemId"], r["score"]))
    for u, bu in users.items():
        assert got[u] == [(i, pytest.approx(min(5, max(-2, biases.mean + bu - b)))) for b, i in items]


def test_tuning_names_one_best_setting(planted):
    rows = cf.tune_cf(planted, {"rank": [1, 4], "max_iter": [6], "reg": [0.05, 5]}, folds=2).collect()
    assert len(rows) == 4 and sum(r["best"] for r in rows) == 1
    best = next(r for r in rows if r["best"])
    assert best["rmse"] == min(r["rmse"] for r in rows) and (best["rank"], best["reg"]) == (4, 0.05)
    assert all(r["mae"] <= r["rmse"] for r in rows)


def test_folds_are_repeatable_and_cover_all(planted):
    one, two = (cf.with_folds(planted, 5).groupBy("fold").count().collect() for _ in range(2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and {r["fold"] for r in one} == set(range(5))


def test_default_grid_has_the_ranges():
    assert cf.GRID["rank"][0] == 20 and cf.GRID["rank"][-1] == 100 and len(cf.GRID["rank"]) == 9
    assert cf.GRID["max_iter"] == [10, 12, 14, 16, 18, 20, 22, 24, 26, 28] and len(cf.GRID["reg"]) == 8
