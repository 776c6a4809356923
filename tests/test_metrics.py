import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from versetide.operators.metrics import ranker_metrics


def brute(rows):
    pos, neg = ([s for s, l in rows if (l > 0) == up] for up in (True, False))
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [2, 7, 10_000])
def test_area_and_loss_equal_the_definition(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice("ab"), rng.randrange(levels + 1) / levels, int(rng.random() < 0.3)) for _ in range(600)]
    rows += [("only", 0.5, 1), ("only", 0.2, 1)]
    df = spark.createDataFrame(rows, "kind string, score double, label int")
    got = {r["kind"]: r for r in ranker_metrics(df.unionByName(df.limit(1).withColumn("score", F.lit(None).cast("double"))), "kind").collect()}
    for kind in ("a", "b", "only"):
        mine = [(s, l) for k, s, l in rows if k == kind]
        want = brute(mine)
        assert got[kind]["auc"] == (None if want is None else pytest.approx(want))
        safe = [(min(max(s, 1e-15), 1 - 1e-15), l) for s, l in mine]
        loss = [-math.log(s if l else 1 - s) for s, l in safe]
        assert got[kind]["logloss"] == pytest.approx(sum(loss) / len(loss), rel=1e-6)
        assert got[kind]["n"] == len(mine) and got[kind]["positives"] == sum(l for _, l in mine)


def test_equals_the_evaluator_over_several_ranges(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000 / 1000.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("double").alias("label"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = ranker_metrics(df).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert got["auc"] == pytest.approx(want, abs=1e-12) and got["n"] == 5000


def test_no_rows(spark):
    assert ranker_metrics(spark.createDataFrame([], "label int, score double")).collect() == []
