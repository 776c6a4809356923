import hashlib

import pytest
from pyspark.sql import functions as F

from versetide.functions.parsing import digest
from versetide.operators.ranking import (
    dense_positions,
    sample_per_group,
    sample_rows,
    to_lists,
    top_k,
)
from versetide.operators.samples import add_negatives, label_balance, lists_wanted, negatives_from


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_sample_rows_takes_the_first_in_hash_order(spark, n):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    want = sorted(range(500), key=lambda i: (md5(f"9:{i}"), i))[:n]
    assert sorted(r["id"] for r in sample_rows(df, "id", n, 9).collect()) == sorted(want)


def test_sample_per_group_draws_without_replacement(spark):
    df = spark.createDataFrame([(g, k) for g in range(3) for k in range(4 + g)], "g int, k int")
    got = sample_per_group(df, ["g"], "k", 5, 1).collect()
    assert len(got) == len({(r["g"], r["k"]) for r in got}) == 4 + 5 + 5
    want = sorted(range(6), key=lambda k: md5(f"1:2:{k}"))[:5]
    assert sorted(r["k"] for r in got if r["g"] == 2) == sorted(want)


def test_dense_positions_are_the_hash_order_within_each_part(spark):
    df = spark.createDataFrame([(p, i) for p, n in (("hot", 3000), ("cold", 3)) for i in range(n)], "p string, i int")
    placed = dense_positions(df.withColumn("d", digest(3, "p", "i")), ["p"], "d", "i").collect()
    for part, n in (("hot", 3000), ("cold", 3)):
        rows = sorted((r for r in placed if r["p"] == part), key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(n)) and {r["n"] for r in rows} == {n}
        assert [r["i"] for r in rows] == sorted(range(n), key=lambda i: md5(f"3:{part}:{i}"))


def test_top_k_and_lists(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (1, 12, 0.5), (2, 13, 0.1)], "u int, i int, s double")
    ranked = top_k(df, ["u"], [F.desc("s"), F.col("i")], 2)
    assert {r["u"]: r["items"] for r in to_lists(ranked, "u", "i").collect()} == {1: [11, 10], 2: [13]}


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("u"), "id")
    plan = top_k(df, ["u"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


LOG = "userId long, itemId int, rating long, label int"


def make_log(spark, pos, neg):
    rows = [(1, i, 3, 1) for i in range(pos)] + [(2, i, -2, 0) for i in range(neg)]
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("pos, neg, ratio, want", [(50, 10, 1, 4), (59, 10, 1, 4), (60, 10, 2, 2), (5, 10, 1, 0), (7, 0, 1, 0)])
def test_lists_wanted(spark, pos, neg, ratio, want):
    assert lists_wanted(make_log(spark, pos, neg), ratio) == want


def test_label_balance(spark):
    assert {r["label"]: r["n"] for r in label_balance(make_log(spark, 3, 2)).collect()} == {1: 3, 0: 2}


def test_negatives_equal_the_group_sum(spark):
    log = make_log(spark, 60, 5).unionByName(spark.createDataFrame([(3, None, None, 0), (4, None, 2, 1)], LOG))
    impressions = spark.createDataFrame(
        [(str(u), u, [1, 2, 2, 700 + u]) for u in range(1, 30)],
        "impressionId string, userId long, items array<int>",
    )
    got = add_negatives(log, impressions, seed=5)
    drawn = sample_rows(impressions, "impressionId", lists_wanted(log), 5)
    both = log.unionByName(negatives_from(drawn)).groupBy("userId", "itemId").agg(F.sum("rating").alias("rating"))
    both = both.withColumn("label", F.when(F.col("rating") > 0, 1).otherwise(0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    assert got.count() > log.count()
