import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versetide.functions.parsing import POET_METHODS
from versetide.operators.events import clean_log, engagement_ratings, keep_item_events, parse_report, score_events

LOG = "userId string, url string, method string, parameter string"


def at(method):
    return f"[log]svc[fn]{method}"


def test_search_and_null_urls_go_and_slash_search_stays(spark):
    log = spark.createDataFrame(
        [("1", "search?x", at("toPoemDetails"), "p"), ("2", "/search", at("toPoemDetails"), "p"),
         ("3", None, at("toPoemDetails"), "p"), ("4", "/poem", "[log]toPoemDetails", "p"),
         ("5", "/poem", at("collectAuthor"), "p"), ("6", "/poem", None, "p"), ("7", "/x", at("collectPoem"), None)],
        LOG,
    )
    assert sorted(r["userId"] for r in clean_log(log).collect()) == ["2", "7"]


def test_poet_methods_on_request(spark):
    df = spark.createDataFrame([("collectAuthor",), ("toPoemDetails",)], "method string")
    assert [r[0] for r in keep_item_events(df, POET_METHODS).collect()] == ["collectAuthor"]


@pytest.mark.parametrize("method, parameter, item, rating", [
    ("toPoemDetails", "poemId=12", 12, 1),
    ("toPoemDetails", "poemId=12&x=1", None, None),
    ("toPoemDetails", "bad", None, None),
    ("toPoemDetails", "", None, None),
    ("toPoemDetails", None, None, None),
    ("toPoemDetails", "poemId=3.7", None, None),
    ("showPoetryDetails", "id=12&from=list", 12, 1),
    ("showPoetryDetails", "userId=5&poemId=7&", 5, 1),
    ("showPoetryDetails", "id=12", None, None),
    ("collectPoem", "poemId=12&collection=1", 12, 2),
    ("collectPoem", "poemId=12&collection=0", 12, -2),
    ("collectPoem", "poemId=12&collection=00", 12, 2),
    ("collectPoem", "poemId=12", None, None),
    ("collectPoem", "poemId=x&collection=0", None, -2),
    ("evaluatePoem", "like=1&poemId=12", 12, 2),
    ("evaluatePoem", "like=0&poemId=12", 12, -2),
    ("evaluatePoem", "like=00&poemId=12", 12, 2),
    ("evaluatePoem", "poemId=12&like=1", None, None),
])
def test_scores(spark, method, parameter, item, rating):
    df = spark.createDataFrame([("9", method, parameter)], "userId string, method string, parameter string")
    row = score_events(df).first()
    assert (row["userId"], row["itemId"], row["rating"]) == (9, item, rating)


PATTERNS = {
    "toPoemDetails": (r"poemId=(.+)", 1), "showPoetryDetails": (r"d=(.*?)&", 1),
    "collectPoem": (r"poemId=(.*?)&collection=(.+)", 1), "evaluatePoem": (r"like=(.+)&poemId=(.+)", 2),
}
pieces = st.lists(
    st.sampled_from(["poemId=", "id=", "like=", "collection=", "&", "12", "0", "7", "x", "\n", " ", "d="]), max_size=8
).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(sorted(PATTERNS)), pieces), min_size=1, max_size=20))
def test_item_ids_follow_the_patterns(spark, rows):
    df = spark.createDataFrame([(str(i), m, p) for i, (m, p) in enumerate(rows)],
                               "userId string, method string, parameter string")
    got = {r["userId"]: r["itemId"] for r in score_events(df).collect()}
    for i, (method, parameter) in enumerate(rows):
        pattern, group = PATTERNS[method]
        found = re.search(pattern, parameter)
        text = found.group(group).strip(" \n") if found else ""
        assert got[i] == (int(text) if re.fullmatch(r"[+-]?\d+", text) else None), (method, parameter)


def test_ratings_are_summed_and_a_null_sum_has_label_0(spark):
    scored = spark.createDataFrame(
        [(1, 5, 1), (1, 5, 2), (1, 6, 2), (1, 6, -2), (2, 5, -2), (2, None, None), (2, None, None)],
        "userId long, itemId int, rating int",
    )
    rows = {(r["userId"], r["itemId"]): (r["rating"], r["label"]) for r in engagement_ratings(scored).collect()}
    assert rows == {(1, 5): (3, 1), (1, 6): (0, 0), (2, 5): (-2, 0), (2, None): (None, 0)}


def test_parse_report_counts_misses(spark):
    df = spark.createDataFrame(
        [("1", "toPoemDetails", "bad"), ("1", "toPoemDetails", "poemId=1"), ("1", "collectPoem", "poemId=x&collection=1")],
        "userId string, method string, parameter string",
    )
    rows = {r["method"]: (r["events"], r["no_item"], r["no_rating"]) for r in parse_report(df).collect()}
    assert rows == {"toPoemDetails": (2, 1, 1), "collectPoem": (1, 1, 0)}


def test_scores_equal_the_union_of_the_four_groups(spark):
    rows = [(str(i % 7), m, f"id={i}&like={i % 2}&poemId={i}&collection={i % 3}")
            for i in range(60) for m in PATTERNS]
    df = spark.createDataFrame(rows, "userId string, method string, parameter string")
    together = sorted(map(tuple, score_events(df).collect()), key=str)
    apart = sorted(
        (tuple(r) for m in PATTERNS for r in score_events(df.where(F.col("method") == m)).collect()), key=str
    )
    assert together == apart
