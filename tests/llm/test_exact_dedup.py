import hashlib
import random
from collections import defaultdict

import pytest

from versetide.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, n bigint, keep string, _name string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def write(spark, rows, path, parts=3, mode="overwrite"):
    spark.createDataFrame([(i, t, 7, "k", "x") for i, t in rows], SCHEMA).repartition(parts).write.mode(mode).parquet(path)


def run(spark, path, store, **options):
    exact_dedup.ingest(spark, path, store, **options).awaitTermination()
    options.pop("batch_bytes", None)
    state = exact_dedup.retained(spark, store)
    return [r.asDict() for r in exact_dedup.resolve(spark.read.parquet(path), state, **options).collect()]


def check(rows, got):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    expected = sorted(
        (str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items() for i in ids
    )
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == expected
    stays = [r for r in got if r["kept"]]
    assert len(stays) == len(groups) and len({r["text_sha256"] for r in stays}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in stays)


def rows_of(n=120, seed=5):
    rng = random.Random(seed)
    texts = ["", None, "a", "A", "Ä", "ä", "same TEXT", "Same text", "same text ", "x" * 300_000, "X" * 300_000, "é\n", "日本"]
    rows = [(i, rng.choice(texts) if rng.random() < 0.6 else f"own {i}") for i in range(n)]
    return rows + [(None, "a"), (None, "lonely"), (3, "a"), (3, "a"), rows[0], (9, None)]


@pytest.mark.parametrize("name_bytes", [32, 1])  # one byte: most names hold different bytes
def test_equals_brute_force(spark, tmp_path, name_bytes):
    rows = rows_of()
    write(spark, rows, str(tmp_path / "docs"))
    check(rows, run(spark, str(tmp_path / "docs"), str(tmp_path / "state"), name_bytes=name_bytes))


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    path, store = str(tmp_path / "docs"), str(tmp_path / "state")
    first, second = rows_of(60, 1), [(1000 + i, t) for i, (_, t) in enumerate(rows_of(60, 2))]
    write(spark, first, path)
    query = exact_dedup.ingest(spark, path, store, batch_bytes=1)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3  # a file is a batch
    write(spark, second, path, mode="append")
    check(first + second, run(spark, path, store))
    before = exact_dedup.retained(spark, store).collect()
    exact_dedup.ingest(spark, path, store).awaitTermination()  # nothing new: nothing is counted twice
    assert sorted(exact_dedup.retained(spark, store).collect()) == sorted(before)


def test_hot_text_is_added_up_before_the_shuffle(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(3000)]
    write(spark, rows, str(tmp_path / "docs"), parts=6)
    query = exact_dedup.ingest(spark, str(tmp_path / "docs"), str(tmp_path / "state"))
    query.awaitTermination()
    moved = sum(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"])
    assert moved == 1001
    check(rows, [r.asDict() for r in exact_dedup.resolve(
        spark.read.parquet(str(tmp_path / "docs")), exact_dedup.retained(spark, str(tmp_path / "state"))).collect()])


def test_empty_table(spark, tmp_path):
    write(spark, [], str(tmp_path / "docs"), parts=1)
    assert run(spark, str(tmp_path / "docs"), str(tmp_path / "state")) == []
