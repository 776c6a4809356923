import pytest

from versetide import schemas, session
from versetide.sources.batch import jdbc_options, read_csv, read_log_lines, read_table


def test_jdbc_options():
    base = {"url": "jdbc:x", "dbtable": "t"}
    assert jdbc_options(base) == base
    got = jdbc_options(base, {"column": "id", "lower": 1, "upper": 900, "parts": 8})
    assert got == {"url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": "1", "upperBound": "900",
                   "numPartitions": "8"}
    assert base == {"url": "jdbc:x", "dbtable": "t"}


def test_csv_is_text_without_a_schema(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("poemId,poemStar\n1,2.5\n2,\n")
    assert dict(read_csv(spark, str(path)).dtypes) == {"poemId": "string", "poemStar": "string"}
    rows = read_csv(spark, str(path), "poemId int, poemStar double").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5), (2, None)]


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("1,x\nfiled1, filed2, filed3\n\n2,filed1\n")
    (tmp_path / "b.log").write_text("3,z\n")
    lines = sorted(r["value"] for r in read_log_lines(spark, str(tmp_path)).collect())
    assert lines == ["", "1,x", "2,filed1", "3,z"]
    rows = read_log_lines(spark, str(tmp_path), "id int, word string").where("id is not null").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, "filed1"), (3, "z")]


def test_log_lines_with_a_struct_schema(spark, tmp_path):
    (tmp_path / "a.log").write_text("5,m\n")
    row = read_log_lines(spark, str(tmp_path), schemas.USER_INFO).first()
    assert tuple(row) == (5, "m")


def test_table(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_table(spark, "three").count() == 3


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", "")
    folder = session.shared_folder(spark)
    assert folder == named.rstrip("/") if named else folder == session.shared_folder(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_settle_keeps_rows_and_cuts_the_plan(spark):
    df = session.settle(spark.range(10).selectExpr("id", "array(id) as a"), "t")
    assert df.count() == 10 and df.columns == ["id", "a"]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit, hint", [(1000, True), (10, False)])
def test_broadcast_only_below_the_limit(spark, limit, hint):
    df = session.broadcast_if_small(spark.range(10), 8, limit)
    assert ("broadcast" in df._jdf.queryExecution().logical().toString().lower()) == hint


def test_emptied_frees_only_its_own_table(spark):
    one, two = (session.settle(spark.range(n).select("id"), "freed") for n in (5, 7))
    files = one.inputFiles()
    session.emptied(one.where("id > 1"))
    assert not set(files) & set(spark.read.parquet(files[0].rsplit("/", 1)[0]).inputFiles())
    assert two.count() == 7
