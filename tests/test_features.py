import pytest
from pyspark.sql import functions as F

from versetide.operators.features import (
    feature_vocab,
    flag_favourite_author,
    join_items,
    join_users,
    multi_hot,
    one_hot_table,
    sparse_training_set,
    term_table,
    training_set,
)

ITEMS = "poemId int, poemAuthorId int, poemStar double, poemDynasty string, poemTagNames string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, 200007, 3.0, "Tang", "moon,river"), (2, 200008, None, "Song", "moon"), (3, 200009, 5.0, "Song", None),
         (4, 200007, 1.0, "Tang", "Tang,wine")], ITEMS)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [(1, 1, 3, 1), (1, 2, 1, 1), (2, 3, -2, 0), (3, 1, 1, 1), (1, None, None, 0), (2, 99, 1, 1), (9, 4, 2, 1)],
        "userId long, itemId int, rating long, label int")


def test_vocabulary_is_ordered_and_bounded(items):
    assert feature_vocab(items) == ["Song", "Tang", "moon", "river", "wine"]
    with pytest.raises(ValueError):
        feature_vocab(items, 4)


def test_multi_hot(items):
    rows = {r["poemId"]: list(r["indicators"].toArray()) for r in multi_hot(items, feature_vocab(items)).collect()}
    assert rows == {1: [0, 1, 1, 1, 0], 2: [1, 0, 1, 0, 0], 3: [1, 0, 0, 0, 0], 4: [0, 1, 0, 0, 1]}


def test_join_items_equals_outer_join_and_null_drop(items, log):
    wide = one_hot_table(items, feature_vocab(items))
    got = join_items(log, wide)
    outer = log.join(wide.drop("poemDynasty"), log["itemId"] == F.col("poemId"), "outer").dropna()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, outer.collect()))
    assert {(r["userId"], r["itemId"]) for r in got.collect()} == {(1, 1), (2, 3), (3, 1), (9, 4)}


def test_users_keep_a_null_sex_and_lose_the_unknown(spark, items, log):
    users = spark.createDataFrame([(1, "f"), (2, None), (9, "m")], "userId long, userSex string")
    rows = join_users(join_items(log, items.drop("poemTagNames")), users)
    assert {(r["userId"], r["userSex"]) for r in rows.collect()} == {(1, "f"), (2, None), (9, "m")}
    assert rows.columns.count("userId") == 1


def test_favourite_author_with_duplicate_pairs(spark):
    df = spark.createDataFrame([(1, 200007), (1, 200008), (2, 200007)], "userId long, poemAuthorId int")
    favourites = spark.createDataFrame([(1, 7), (1, 7), (3, 7)], "userId long, authorId long")
    rows = flag_favourite_author(df, favourites).collect()
    assert sorted((r["userId"], r["poemAuthorId"], r["collectAuthor"]) for r in rows) == [
        (1, 200007, 1), (1, 200008, 0), (2, 200007, 0)]


def test_training_set(spark, items, log):
    users = spark.createDataFrame([(1, "f"), (2, "m"), (9, "m")], "userId long, userSex string")
    favourites = spark.createDataFrame([(1, 7), (2, 1)], "userId long, authorId long")
    df = training_set(log, one_hot_table(items, feature_vocab(items)), users, favourites)
    assert df.columns == ["rating", "label", "poemStar", "Song", "Tang", "moon", "river", "wine", "userSex", "collectAuthor"]
    assert sorted(map(tuple, df.collect())) == sorted([
        (3, 1, 3.0, 0, 1, 1, 1, 0, "f", 1), (-2, 0, 5.0, 1, 0, 0, 0, 0, "m", 0), (2, 1, 1.0, 0, 1, 0, 0, 1, "m", 0)])
    assert dict(df.dtypes)["moon"] == "bigint"


def test_sparse_training_set_takes_any_term(spark, log):
    names = ["Red", "red", "rating", "a`b", "userId", "x.y", "Song"]
    items = spark.createDataFrame(
        [(1, 200007, 3.0, "Tang", ",".join(names)), (3, 200009, 5.0, "Song", None), (4, 200007, 1.0, None, None)], ITEMS)
    users = spark.createDataFrame([(1, "f"), (2, "m"), (9, "m")], "userId long, userSex string")
    favourites = spark.createDataFrame([(1, 7)], "userId long, authorId long")
    terms = term_table(items)
    ids = {r["term"]: r["termId"] for r in terms.collect()}
    assert sorted(ids) == sorted([*names, "Tang"]) and sorted(ids.values()) == list(range(8))
    got = {(r["userId"], r["itemId"]): r for r in sparse_training_set(log, items, users, favourites, terms).collect()}
    assert set(got) == {(1, 1), (2, 3), (9, 4)} and got[9, 4]["indicators"] == []
    assert got[1, 1]["indicators"] == sorted(ids[n] for n in [*names, "Tang"]) and got[2, 3]["indicators"] == [ids["Song"]]
    assert (got[1, 1]["collectAuthor"], got[2, 3]["userSex"]) == (1, "m")


def test_a_hundred_thousand_terms(spark):
    items = spark.range(1000).select(
        F.col("id").cast("int").alias("poemId"), F.lit(1).alias("poemAuthorId"), F.lit(1.0).alias("poemStar"), F.lit("d").alias("poemDynasty"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("t"), F.col("id") * 100 + i)), ",").alias("poemTagNames"))
    ids = term_table(items)
    assert ids.count() == 100_001 and ids.agg(F.max("termId")).first()[0] == 100_000
