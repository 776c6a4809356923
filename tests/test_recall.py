import pytest
from pyspark.sql import functions as F

from versetide.operators.recall import (
    draw_tag_items,
    last_actions,
    parse_activity,
    recall,
    recent_activity,
    similar_to_recent,
    tag_index,
    tag_lists,
    user_tags,
    with_default_tags,
)
from versetide.plans.serve import (
    daily_for,
    daily_list,
    guess_you_like,
    most_similar,
    shown_lists,
)
from versetide.sources.sinks import append_impressions, to_payload
from versetide.operators.samples import negatives_from

ITEMS = "poemId int, poemAuthorId int, poemStar double, poemDynasty string, poemTagNames string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, 200000 + i % 3, float(i % 9), "Tang", "few" if i < 4 else "five" if i < 9 else None) for i in range(40)]
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="module")
def index(items):
    return tag_index(items, 1).cache()


def test_last_eleven_of_twelve(spark, items):
    events = spark.createDataFrame([(1, i, 100 + i // 2, i) for i in range(12)] + [(2, 50, 1, None)],
                                   "userId long, eventId long, ts int, itemId int")
    assert sorted(r["eventId"] for r in last_actions(events).where("userId = 1").collect()) == list(range(1, 12))
    lists = {r["userId"]: r["recent"] for r in recent_activity(events, items).collect()}
    assert len(lists[1]) == 11 and lists[1][0] == "11-Tang" and lists[1][-1] == "1-Tang-few"
    assert lists[2] == ["NoPoemID"]


def test_entries(spark):
    recent = spark.createDataFrame([(1, ["12-a-b", "NoPoemID-c", "12", "x-d"]), (2, [])], "userId long, recent array<string>")
    rows = [(r["pos"], r["itemId"], r["tags"]) for r in parse_activity(recent).orderBy("pos").collect()]
    assert rows == [(0, 12, ["a", "b"]), (1, None, ["c"]), (2, 12, []), (3, None, ["d"])]


def test_at_most_five_tags_and_defaults_for_the_rest(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "userId long")
    recent = spark.createDataFrame([(1, ["1-a-b-c-d-e-f-g"]), (2, ["7"]), (8, ["1-a"])], "userId long, recent array<string>")
    tags = user_tags(users, parse_activity(recent))
    assert tags.where("userId = 1").count() == 5 and tags.where("userId = 8").count() == 0
    full = with_default_tags(users, tags, ("x", "y"))
    got = {u: sorted(r["tag"] for r in full.collect() if r["userId"] == u) for u in (2, 3)}
    assert got == {2: ["x", "y"], 3: ["x", "y"]}


def test_tag_index_is_whole(index):
    rows = index.collect()
    by_tag = {t: sorted(r["itemId"] for r in rows if r["tag"] == t) for t in {r["tag"] for r in rows}}
    assert by_tag == {"Tang": list(range(40)), "few": [0, 1, 2, 3], "five": [4, 5, 6, 7, 8]}
    assert {r["tag"]: r["n"] for r in rows} == {"Tang": 40, "few": 4, "five": 5}
    chunks = tag_lists(index, 15).where("tag = 'Tang'").orderBy("chunk").collect()
    assert [len(r["items"]) for r in chunks] == [15, 15, 10]
    assert [i for r in chunks for i in r["items"]] == [
        r["itemId"] for r in sorted((r for r in rows if r["tag"] == "Tang"), key=lambda r: r["pos"])]


def test_draws_are_whole_below_five_and_five_above(spark, index):
    tags = spark.createDataFrame([(u, t) for u in range(300) for t in ("few", "five", "Tang", "none")], "userId long, tag string")
    for tag, want in (("few", 4), ("five", 5), ("Tang", 5)):
        drawn = draw_tag_items(tags.where(F.col("tag") == tag), index, seed=4)
        per_user = drawn.groupBy("userId").agg(F.countDistinct("itemId").alias("n"), F.count("*").alias("rows"))
        assert {(r["n"], r["rows"]) for r in per_user.collect()} == {(want, want)}
        assert drawn.select("userId").distinct().count() == 300
    assert draw_tag_items(tags.where("tag = 'Tang'"), index, seed=4).select("itemId").distinct().count() == 40
    assert draw_tag_items(tags.where("tag = 'none'"), index).count() == 0


def test_similar_items_of_recent_ones(spark):
    recent = spark.createDataFrame([(1, ["5-a", "6", "5"])], "userId long, recent array<string>")
    similar = spark.createDataFrame([(5, list(range(100, 120))), (7, [1])], "poemId long, top100 array<long>")
    got = sorted(r["itemId"] for r in similar_to_recent(parse_activity(recent), similar).collect())
    assert got == list(range(100, 110))


class Star:
    @staticmethod
    def transform(rows):
        return rows.withColumn("score", F.col("poemStar"))


def test_guess_you_like(spark, items, index):
    users = spark.createDataFrame([(1,), (2,)], "userId long")
    info = spark.createDataFrame([(1, "f"), (2, "m")], "userId long, userSex string")
    favourites = spark.createDataFrame([(1, 1)], "userId long, authorId long")
    recent = spark.createDataFrame([(1, ["3-few"])], "userId long, recent array<string>")
    similar = spark.createDataFrame([(3, [20, 21, 999])], "poemId long, top100 array<long>")
    args = (users, recent, similar, index)
    candidates = {(r["userId"], r["itemId"]) for r in recall(*args, defaults=("five",)).collect()}
    assert candidates == {(1, i) for i in (0, 1, 2, 3, 20, 21, 999)} | {(2, i) for i in range(4, 9)}
    ranked = guess_you_like(*args, items, info, favourites, Star, ("five",), k=3)
    lists = shown_lists(ranked)
    assert {r["userId"]: r["items"] for r in lists.collect()} == {1: [3, 21, 2], 2: [8, 7, 6]}
    payload = {r["userId"]: r["payload"] for r in to_payload(lists, "rs").collect()}
    assert payload == {1: '{"rs":[3,21,2]}', 2: '{"rs":[8,7,6]}'}


def test_shown_lists_come_back_as_negatives(spark, tmp_path):
    lists = spark.createDataFrame([(1, [3, 4]), (2, [5])], "userId long, items array<long>")
    path = str(tmp_path / "shown")
    append_impressions(lists, path, "d1")
    append_impressions(lists, path, "d2")
    stored = spark.read.parquet(path)
    assert stored.select("impressionId").distinct().count() == 4
    rows = negatives_from(stored).collect()
    assert sorted(map(tuple, rows)) == sorted([(1, 3, 0, 0), (1, 4, 0, 0), (2, 5, 0, 0)] * 2)


def test_most_similar_and_daily(spark):
    similar = spark.createDataFrame([(1, list(range(100))), (2, [9])], "poemId long, top100 array<long>")
    rows = {r["poemId"]: r["payload"] for r in to_payload(most_similar(similar)).collect()}
    assert rows == {1: "[0,1,2,3,4,5,6,7,8,9]", 2: "[9]"}
    stored = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(30)], "userId long, itemId long")
    one, two = (shown_lists(daily_list(stored, d)).orderBy("userId").collect() for d in ("a", "b"))
    assert [len(set(r["items"])) for r in one] == [10, 10] and one != two
    users = spark.createDataFrame([(1,), (7,)], "userId long")
    asked = {r["userId"]: r["payload"] for r in to_payload(daily_for(users, shown_lists(daily_list(stored, "a"))), "rijian").collect()}
    assert asked[7] == '{"rijian":null}' and asked[1].startswith('{"rijian":[')
