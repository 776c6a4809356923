import os

import pytest
from pyspark.sql import functions as F

from versetide.llm import language as L

SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_held_out_accuracy_with_missing_and_wrong_declarations(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wrong = F.when(F.col("lang") == "en", "de").otherwise("en")
    said = docs.withColumn("said", F.when(F.col("doc_id") % 10 == 0, wrong).when(F.col("doc_id") % 10 < 4, None).otherwise(F.col("lang")))
    got = L.identify(said, declared=F.col("said"), host=F.col("source")).where("doc_id % 10 < 4").toPandas()
    assert (got["lang"] == got["language"]).mean() >= 0.97
    assert got["kept"].mean() >= 0.97


def rows(spark, more=()):
    texts = [("the man and the house of the king with that", "en"), ("der mann und das haus des königs mit dem", "de")]
    base = [(i, texts[i % 2][0] * 5, texts[i % 2][1], f"h{i % 2}.x{i % 2}") for i in range(60)]
    return spark.createDataFrame(base + list(more), "doc_id long, text string, said string, host string")


def run(docs):
    return {r.doc_id: r for r in L.identify(docs, declared=F.col("said"), host=F.col("host"), domain=F.substring_index("host", ".", -1)).collect()}


def test_evidence_decides_where_the_text_cannot(spark):
    got = run(rows(spark, [(100, "ok", None, "h1.x1"), (101, "ok", None, "new.x1"), (102, "ok", "de", None), (103, "ok", "en", None),
                           (104, "the man and the house of the king", "de", "h1.x1")]))
    assert [got[i].language for i in range(100, 105)] == ["de", "de", "de", "en", "en"]


def test_rejections_and_repeated_rows(spark):
    got = L.identify(
        rows(spark, [(200, None, "en", None), (201, "", "en", None), (202, "### 12 !!", None, None), (203, "A.", "en", None), (203, "A.", "en", None)]),
        declared=F.col("said"),
    ).where("doc_id >= 200").collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(200, False), (201, False), (202, False), (203, True), (203, True)]


def test_no_declarations_and_empty_table(spark):
    docs = rows(spark)
    assert {r.kept for r in L.identify(docs).collect()} == {False}
    out = L.identify(docs.limit(0), declared=F.col("said"))
    assert out.count() == 0 and {"language", "confidence", "kept"} <= set(out.columns)


def test_clashing_columns_are_replaced(spark):
    docs = rows(spark).withColumn("language", F.lit(1)).withColumn("kept", F.lit("x"))
    assert dict(L.identify(docs, declared=F.col("said")).dtypes)["kept"] == "boolean"


def with_a_rare_language(spark):
    """1200 rows, six of them of a language of its own (0.5 %), five of which declare it."""
    more = [(1000 + i, ("the man and the house of the king with that", "der mann und das haus des königs mit dem")[i % 2] * 5, ("en", "de")[i % 2], None)
            for i in range(1134)]
    rare = "talon kuningas ja mies sekä vanha metsä järven rannalla "
    return rows(spark, more + [(300 + i, rare * 5, None if i == 5 else "fi", None) for i in range(6)])


def test_a_language_of_half_a_percent_is_found_and_kept(spark):
    got = run(with_a_rare_language(spark))
    assert len(got) == 1200
    assert all((got[i].language, got[i].kept) == ("fi", True) for i in range(300, 306))
    assert all((r.language, r.kept) == (r.said, True) for i, r in got.items() if not 300 <= i < 306)


def test_languages_in_blocks_give_the_same_rows(spark, monkeypatch):
    docs = with_a_rare_language(spark)
    whole = run(docs)
    monkeypatch.setattr(L, "TABLE_BYTES", 8 * L.SLOTS)
    assert L.blocks_of(3) == [(0, 1), (1, 2), (2, 3)]
    assert run(docs) == whole
