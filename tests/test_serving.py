"""Serving keeps all users and items, and lookups are unique."""

from pyspark.sql import functions as F

from versetide.operators.features import lookup, ranker_rows
from versetide.operators.products import top_products
from versetide.operators.recall import similar_to_recent
from versetide.operators.text import doc_vectors, similar_items
from versetide.plans.serve import rank_candidates

ITEM = "poemId int, poemAuthorId int, poemStar double, poemDynasty string, poemTagNames string"


def tables(spark):
    items = spark.createDataFrame(
        [(1, 200001, 5.0, "T", "a,b"), (1, 200001, 5.0, "T", "a,b"), (2, None, None, None, None)], ITEM
    )
    users = spark.createDataFrame([(7, "f"), (7, "m")], "userId long, userSex string")
    favourites = spark.createDataFrame([(7, 1)], "userId long, authorId long")
    pairs = spark.createDataFrame([(u, i) for u in (7, 8) for i in (1, 2)], "userId long, itemId long")
    return pairs, items, users, favourites


def test_all_candidates_are_scored_once(spark):
    got = {(r.userId, r.itemId): r for r in ranker_rows(*tables(spark), serving=True).collect()}
    assert len(got) == 4
    assert [got[k].collectAuthor for k in ((7, 1), (7, 2), (8, 1), (8, 2))] == [1, 0, 0, 0]
    assert got[8, 1].userSex is None and got[7, 1].userSex == "f" and got[7, 2].poemStar == 0.0
    scored = ranker_rows(*tables(spark), serving=True).withColumn("score", F.col("poemStar"))
    assert rank_candidates(scored).count() == 4


def test_training_still_needs_both_sides(spark):
    assert [(r.userId, r.itemId) for r in ranker_rows(*tables(spark)).collect()] == [(7, 1)]


def test_lookup_is_unique_and_repeatable(spark):
    table = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (None, "x", 0), (2, None, 1)], "k int, v string, w int")
    assert sorted(map(tuple, lookup(table, "k").collect())) == [(1, "a", 9), (2, None, 1)]


def test_a_doubled_list_recalls_once(spark):
    parsed = spark.createDataFrame([(1, 5)], "userId long, itemId int")
    similar = spark.createDataFrame([(5, [6, 7]), (5, [6, 7])], "poemId long, top100 array<long>")
    assert similar_to_recent(parsed, similar).count() == 2


def test_sent_and_blocked_products_agree(spark):
    rows = [(i, [float((i * 37 + j * 11) % 23 - 11) for j in range(6)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    key = lambda df: sorted((r.id, r.rank, r.target, r.score) for r in df.collect())
    for k in (1, 7, 299, 400):
        sent = key(top_products(vectors, vectors, k))
        assert sent == key(top_products(vectors, vectors, k, cells=9, target_block=20, query_block=50))
        assert len(sent) == 300 * min(k, 300)


def test_a_sent_matrix_moves_no_queries(spark):
    vectors = spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(50)], "id long, vec array<double>")
    plan = top_products(vectors, vectors, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_documents_without_a_vector_keep_a_row(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["all"]), (3, []), (4, ["x", "z"])], "docId long, tokens array<string>")
    words = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "term string, vector array<double>")
    vectors = doc_vectors(docs, words, 4)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("sort_array") <= 1
    assert {r.docId: len(r.vec) for r in vectors.collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    lists = {r.poemId: list(r.top100) for r in similar_items(vectors.select(F.col("docId").alias("id"), "vec"), 3).collect()}
    assert lists == {1: [4], 4: [1], 2: [], 3: []}
