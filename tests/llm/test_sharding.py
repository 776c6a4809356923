from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from versetide.llm import sharding as S
from versetide.session import scratch_path


def shards(spark, rows, n, seed=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, bucket int").repartition(3)
    return S.write_shards(docs, scratch_path(spark, "test-shards"), n, "doc_id", seed=seed)


@pytest.mark.parametrize("count, n, rows_each", [(1000, 7, 30), (1000, 24, 4000), (5, 24, 10), (1, 3, 10)])
def test_law_slots_and_contents(spark, monkeypatch, count, n, rows_each):
    monkeypatch.setattr(S, "BUCKET_ROWS", rows_each)
    rows = [(i, f"text {i % 50}", "s", i) for i in range(count)]
    got = shards(spark, rows, n).collect()
    assert Counter((r.doc_id, r.text, r.bucket) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    sizes = Counter(r.shard for r in got)
    filled = [sizes[s] for s in range(n)]
    assert max(filled) - min(filled) <= 1
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_order_is_random_and_seeded(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 100)
    rows = [(i, str(i), "", 0) for i in range(600)]
    order = lambda seed: [r.doc_id for r in sorted(shards(spark, rows, 4, seed).collect(), key=lambda r: (r.shard, r.slot))]
    first = order(1)
    assert first == order(1) and first != order(2)
    assert first != sorted(first)
    rising = sum(a < b for a, b in zip(first, first[1:]))
    assert 240 < rising < 360  # as in a random order
    # inside a bucket the order is not that of the scattered hash either
    assert len({first[i] // 100 for i in range(100)}) == 6


def test_rows_without_key_repeated_rows_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    rows = [(None, None, None, None)] * 100 + [(7, "same", "", 1)] * 10 + [(8, "", "", 1)]
    got = shards(spark, rows, 3).collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(None, None): 100, (7, "same"): 10, (8, ""): 1}
    assert {r.shard for r in got if r.doc_id is None} == {0, 1, 2}


def test_same_shards_for_any_order_and_partitioning(spark, monkeypatch):
    """Several buckets share a task, keys and whole rows repeat, and some have no key."""
    monkeypatch.setattr(S, "BUCKET_ROWS", 50)
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    rows = [(i, f"t{i}", "s", i) for i in range(700)] + [(5, "same", "s", 0)] * 60 + [(6, f"own {i}", "s", 0) for i in range(60)]
    rows += [(None, f"n{i % 30}", "s", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, bucket int")
    found = set()
    for table in (docs.repartition(3), docs.orderBy(F.desc("text")).coalesce(1), docs.repartition(11, "text")):
        got = S.write_shards(table, scratch_path(spark, "test-shards"), 7, "doc_id", seed=3).collect()
        found.add(tuple(sorted(((r.shard, r.slot, r.doc_id, r.text) for r in got), key=str)))
    assert len(found) == 1


def test_hot_key_goes_to_all_buckets(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") % 3).cast("string").alias("text"))
    spread = S.scattered(rows.repartition(5), "doc_id", 40, 1).groupBy("bucket").count().collect()
    assert len(spread) == 40 and max(r["count"] for r in spread) < 3000


def test_empty_table(spark):
    out = shards(spark, [], 4)
    assert out.count() == 0 and {"shard", "slot", "doc_id", "text"} <= set(out.columns)


def test_query_digests(spark, tmp_path):
    rows = [(1, "é", "en", "s", 1), (2, None, "en", "s", 0), (3, "x" * 100_000, "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.op2_shard(spark, str(tmp_path)).collect()}
    for key, text, *_ in rows:
        data = (text or "").encode()
        assert (got[key].size, got[key].text_crc32, got[key].law, got[key].grown_shard) == (len(data) + 8, crc32(data), "rows", None)
