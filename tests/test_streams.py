import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from versetide.operators.recall import last_actions
from versetide.streaming.headers import parse_envelope, parse_headers
from versetide.streaming.jobs import (
    append_events,
    compact_recent,
    print_stream,
    read_event_stream,
    read_recent,
    recent_activity_stream,
    roll_files,
    stored_actions,
)

NONE = (None, None, None, None, None)


@pytest.mark.parametrize("text, want", [
    ("{userId=233, age=3, name=a, itemId=7, click=1}", ("233", "3", "a", "7", "1")),
    ("{userId=233}", ("233", None, None, None, None)),
    ("{name=a b, itemId= 7 }", (None, None, "ab", "7", None)),
    ("{userId=1, userId=2}", ("2", None, None, None, None)),
    ("{age=, click=0}", (None, "", None, None, "0")),
    ("{myuserId=5}", NONE), ("{}", NONE), (None, NONE),
])
def test_header_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "headers string")
    assert tuple(parse_headers(df).first()) == want


def test_envelope_of_two_events(spark):
    body = json.dumps([{"headers": {"userId": "233", "age": "3"}, "body": "filed1, filed2, filed3"},
                       {"headers": {"itemId": "7"}, "body": "b"}])
    df = spark.createDataFrame([(1, body), (2, "[]"), (3, "not json")], "n int, value string")
    events = parse_envelope(df)
    assert sorted(r["body"] for r in events.collect()) == ["b", "filed1, filed2, filed3"]
    rows = parse_headers(events.select("headers")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("233", "3", None, None, None), (None, None, None, "7", None)], key=str)


def test_stream_and_batch_parse_alike(spark, tmp_path):
    texts = [f"{{userId={i}, click={i % 2}}}" for i in range(50)]
    source = str(tmp_path / "in")
    spark.createDataFrame([(t,) for t in texts], "headers string").repartition(7).write.json(source)
    stream = parse_headers(read_event_stream(spark, source, "headers string", files_per_batch=2))
    append_events(stream, str(tmp_path / "log"), str(tmp_path / "ck"), once=True).awaitTermination()
    logged = spark.read.parquet(str(tmp_path / "log"))
    batch = parse_headers(spark.read.schema("headers string").json(source))
    assert sorted(map(tuple, logged.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    roll_files(spark, str(tmp_path / "log"), str(tmp_path / "rolled"), 1000)
    assert spark.read.parquet(str(tmp_path / "rolled")).count() == 50
    # nothing new: a second run adds no rows
    append_events(parse_headers(read_event_stream(spark, source, "headers string")),
                  str(tmp_path / "log"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 50


def test_print_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.json(source)
    query = print_stream(read_event_stream(spark, source, "id long"), once=True)
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture()
def actions(spark):
    start = datetime(2024, 1, 1)
    rows = [(i % 3 if i % 4 else 0, i, start + timedelta(seconds=(i * 37) % 50), f"{i}-t{i % 5}") for i in range(200)]
    return spark.createDataFrame(rows, "userId long, eventId long, ts timestamp, entry string")


def lists(df):
    return {r["userId"]: r["recent"] for r in df.collect()}


def test_stream_of_actions_ends_like_the_batch(spark, actions, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    actions.repartition(6).write.parquet(source)
    stream = read_event_stream(spark, source, actions.schema, "parquet", files_per_batch=1)
    recent_activity_stream(stream, store, str(tmp_path / "ck"), once=True).awaitTermination()
    want = {}
    for r in last_actions(actions).orderBy("userId", "rank").collect():
        want.setdefault(r["userId"], []).append(r["entry"])
    assert lists(read_recent(spark, store)) == want
    merged = str(tmp_path / "merged")
    compact_recent(spark, store, out=merged)
    assert lists(read_recent(spark, merged)) == lists(read_recent(spark, merged, store)) == want
    assert spark.read.parquet(merged).count() == stored_actions(spark, store).count()


def test_runs_add_up(spark, actions, tmp_path):
    """A stream with a new checkpoint loses nothing of an older one; what both have read counts once."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    actions.where("userId < 2").coalesce(1).write.parquet(source)
    for run in ("a", "b"):
        stream = read_event_stream(spark, source, actions.schema, "parquet")
        recent_activity_stream(stream, store, str(tmp_path / run), once=True).awaitTermination()
        actions.where("userId = 2").coalesce(1).write.mode("overwrite").parquet(source)
    third = read_event_stream(spark, source, actions.schema, "parquet")
    recent_activity_stream(third, store, str(tmp_path / "c"), once=True).awaitTermination()
    want = {}
    for r in last_actions(actions).orderBy("userId", "rank").collect():
        want.setdefault(r["userId"], []).append(r["entry"])
    assert lists(read_recent(spark, store)) == want


def test_a_batch_that_runs_again_changes_nothing(spark, actions, tmp_path):
    source, store, checkpoint = str(tmp_path / "in"), str(tmp_path / "store"), tmp_path / "ck"
    actions.repartition(3).write.parquet(source)

    def run():
        stream = read_event_stream(spark, source, actions.schema, "parquet", files_per_batch=1)
        recent_activity_stream(stream, store, str(checkpoint), once=True).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(store).drop("run").collect()), key=str)

    before = run()
    for name in ("2", ".2.crc"):  # as if the driver was lost before the last batch was committed
        if (checkpoint / "commits" / name).exists():
            (checkpoint / "commits" / name).unlink()
    assert run() == before
    assert len([p for p in (tmp_path / "store").glob("run=*/batch=*")]) == 3
