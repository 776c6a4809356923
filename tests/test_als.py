import numpy as np
import pytest
from pyspark.sql import functions as F

from versetide.operators import als, cf

SCHEMA = "userId long, itemId long, left double"


def ratings_of(rng, users=30, items=12, share=0.6):
    return [(u, 100 + i, float(rng.normal())) for u in range(users) for i in range(items) if rng.random() < share]


def solved(rows, held, reg):
    """The half-step written out: a ridge for each key."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = [(held[o], y) for k, o, y in rows if k == key and o in held]
        x, y = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
        out[key] = np.linalg.solve(x.T @ x + reg * len(y) * np.eye(x.shape[1]), x.T @ y) if len(y) else np.zeros(len(next(iter(held.values()))))
    return out


def table(spark, rows, values=None, fold=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("userId", "itemId", F.array(values if values is not None else "left").alias("values"), (fold if fold is not None else F.lit(0)).alias("fold"))


@pytest.mark.parametrize("size, sent", [(1 << 14, als.SENT_BYTES), (3, als.SENT_BYTES), (1 << 14, 0), (3, 0)])
def test_half_step_equals_a_ridge_for_each_key(spark, size, sent):
    rng = np.random.default_rng(4)
    rows = ratings_of(rng)
    held = {100 + i: rng.normal(size=3) for i in range(11)}  # the last item has no vector
    by_user = als.blocks(table(spark, rows), "userId", "itemId", size)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in held.items()], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in als.half_step(by_user, vectors, 3, [als.Setting(0.2)], 1, sent).collect()}
    want = solved(rows, held, 0.2)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("sent", [als.SENT_BYTES, 0])
def test_settings_share_a_sweep(spark, sent):
    """Each regularisation and left-out fold gives what it gives alone."""
    rng = np.random.default_rng(6)
    rows = ratings_of(rng)
    fold = F.col("itemId") % 2
    settings = [als.Setting(reg, f) for reg in (0.1, 2.0) for f in (0, 1)]
    held = {100 + i: rng.normal(size=(4, 2)) for i in range(12)}
    by_user = als.blocks(table(spark, rows, fold=fold.cast("int")), "userId", "itemId", 4)
    by_user = by_user.withColumn("values", F.flatten(F.transform("values", lambda v: F.array(v, v + 1))))
    vectors = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in held.items()], "id long, vec array<double>")
    got = {r["id"]: np.array(r["vec"]).reshape(4, 2) for r in als.half_step(by_user, vectors, 2, settings, 2, sent).collect()}
    for k, s in enumerate(settings):
        seen = [(u, i, y + s.fold) for u, i, y in rows if i % 2 != s.fold]
        want = solved(seen, {i: v[k] for i, v in held.items()}, s.reg)
        assert all(np.allclose(got[u][k], want[u]) for u in want)


def test_hot_key_is_many_tasks_work(spark):
    """A user with nearly all ratings lies in many blocks, each of which sends one sum."""
    rows = [(1, i, float(i % 7)) for i in range(5000)] + [(u, u, 1.0) for u in range(2, 50)]
    by_user = als.blocks(table(spark, rows), "userId", "itemId", 200)
    counts = {r["key"]: r["n"] for r in by_user.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert counts[1] == 25 and all(n == 1 for k, n in counts.items() if k != 1)
    assert by_user.agg(F.max(F.size("others"))).first()[0] < 300
    rng = np.random.default_rng(0)
    held = {i: rng.normal(size=2) for i in range(5000)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in held.items()], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in als.half_step(by_user, vectors, 2, [als.Setting(0.5)]).collect()}
    want = solved(rows, held, 0.5)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("sent", [als.SENT_BYTES, 0])
def test_errors_of_left_out_folds(spark, sent):
    rng = np.random.default_rng(8)
    rows = ratings_of(rng, 10, 6)
    settings = [als.Setting(0.1, f) for f in (0, 1)]
    users = {u: rng.normal(size=(2, 2)) for u in range(9)}  # user 9 has none
    items = {100 + i: rng.normal(size=(2, 2)) for i in range(6)}
    base = {0: 0.5, 1: -0.25}
    values = F.array("left", F.col("left") + 1, F.lit(base[0]), F.lit(base[1]))
    df = spark.createDataFrame(rows, SCHEMA).select("userId", "itemId", values.alias("values"), (F.col("itemId") % 2).cast("int").alias("fold"))
    by_user = als.blocks(df, "userId", "itemId", 3)
    own, held = (spark.createDataFrame([(k, v.ravel().tolist()) for k, v in t.items()], "id long, vec array<double>") for t in (users, items))
    got = {r["setting"]: r for r in als.errors(by_user, own, held, 2, settings, 4, (-1.0, 1.0), sent).collect()}
    for k, s in enumerate(settings):
        miss = [y + s.fold + base[s.fold] - np.clip(base[s.fold] + (users[u][k] @ items[i][k] if u in users else 0), -1, 1) for u, i, y in rows if i % 2 == s.fold]
        assert got[k]["n"] == len(miss)
        assert got[k]["squares"] == pytest.approx(np.square(miss).sum()) and got[k]["distances"] == pytest.approx(np.abs(miss).sum())


def low_rank(rng, users=40, items=25):
    p, q = rng.normal(size=(users, 2)), rng.normal(size=(items, 2))
    rows = [(u, i, float(np.clip(1.5 + p[u] @ q[i], -2, 5))) for u in range(users) for i in range(items) if rng.random() < 0.7]
    return rows


def test_sweep_finds_a_setting_and_feeds_the_fit(spark):
    rng = np.random.default_rng(2)
    ratings = spark.createDataFrame(low_rank(rng), "userId long, itemId long, rating double")
    grid = {"rank": [2, 3], "max_iter": [1, 4], "reg": [0.02, 5]}
    tuned = cf.sweep_cf(ratings, grid, folds=3)
    rows = tuned.collect()
    assert len(rows) == 8 and sum(r["best"] for r in rows) == 1
    best = next(r for r in rows if r["best"])
    assert best["reg"] == 0.02 and best["max_iter"] == 4 and best["rmse"] == min(r["rmse"] for r in rows)
    model = cf.fit_best(ratings, tuned)
    miss = model.transform(ratings).agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))).first()[0]
    assert miss < 0.5 and miss < best["rmse"]
    # a longer sweep passes through the errors of a shorter one
    short = cf.sweep_cf(ratings, {**grid, "max_iter": [1]}, folds=3).collect()
    errors = {(r["rank"], r["reg"]): r["rmse"] for r in rows if r["max_iter"] == 1}
    assert all(errors[r["rank"], r["reg"]] == pytest.approx(r["rmse"]) for r in short)


def test_no_ratings(spark):
    ratings = spark.createDataFrame([], "userId long, itemId long, rating double")
    assert cf.sweep_cf(ratings, {"rank": [2], "max_iter": [1], "reg": [0.1]}, folds=2).collect() == []
    with pytest.raises(ValueError):
        cf.fit_best(ratings, cf.sweep_cf(ratings, {"rank": [2], "max_iter": [1], "reg": [0.1]}, folds=2))
    assert cf.fit_sums(ratings, 2, 1).users.count() == 0
