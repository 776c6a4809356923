import numpy as np
import pytest
from pyspark.sql import functions as F

from versetide.operators import machine, ranker
from versetide.operators.metrics import ranker_metrics


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for u in range(60):
        for i in range(20):
            tag, sex = ("moon", "f") if (u + i) % 3 else ("wine", "m")
            star = float(i % 10)
            label = int((tag == "moon") == (star > 4))  # an interaction: no linear rule finds it
            data.append((u, i, star, "Tang", f"{tag},river", sex, u % 2, label))
    return spark.createDataFrame(
        data, "userId long, itemId long, poemStar double, poemDynasty string, poemTagNames string, userSex string, "
        "collectAuthor int, label int").cache()


@pytest.fixture(scope="module")
def terms(rows):
    return ranker.ranker_terms(rows, rows)


def test_trees_find_an_interaction_that_a_linear_model_misses(rows, terms):
    table = {r["kind"]: r for r in ranker.compare_rankers(rows, terms, n_trees=8).collect()}
    assert set(table) == set(ranker.KINDS)
    assert table["trees+lr"]["auc"] > 0.95 and table["trees+fm"]["auc"] > 0.9
    assert table["lr"]["auc"] < 0.8
    assert table["trees+lr"]["logloss"] < table["lr"]["logloss"]


@pytest.mark.parametrize("kind", ["lr", "trees+fm"])
def test_save_load_and_same_columns_for_a_part(spark, rows, terms, tmp_path, kind):
    model = ranker.fit_ranker(rows, kind, terms, n_trees=4)
    model.save(str(tmp_path / kind))
    back = ranker.Ranker.load(spark, str(tmp_path / kind))
    whole = {(r["userId"], r["itemId"]): r["score"] for r in model.transform(rows).collect()}
    part = back.transform(rows.where("userId = 7").drop("label"))
    got = {(r["userId"], r["itemId"]): r["score"] for r in part.collect()}
    assert len(got) == 20 and got == pytest.approx({k: whole[k] for k in got})
    assert "features" not in part.columns and "rawPrediction" not in part.columns


def test_leaves_are_one_hot_per_tree(rows, terms):
    df = ranker.assemble(rows, terms)
    trees = ranker.fit_leaf_encoder(df, 5, 2)
    encoded = ranker.encode_leaves(trees, df, 2).select("features").first()[0]
    assert encoded.size == 5 * 4 and sum(encoded.toArray()) == 5
    assert all(sum(encoded.toArray()[t * 4:(t + 1) * 4]) == 1 for t in range(5))


def test_routed_leaves_are_those_of_the_model(rows, terms):
    df = ranker.assemble(rows, terms)
    trees = ranker.fit_leaf_encoder(df, 6, 3)
    told = ranker.leaf_slots(trees.transform(df), ranker.fitted_trees(trees), 8).select("leaf", "slots").collect()
    assert {len(set(r["slots"])) for r in told} == {6}
    assert all([s % 8 for s in r["slots"]] == [int(x) for x in r["leaf"]] for r in told)


def test_features_without_a_list_of_terms(spark, terms, rows):
    ids = {r["term"]: r["termId"] for r in terms.collect()}
    assert set(ids) == {"Tang", "moon", "wine", "river", "sex=f", "sex=m"} and set(ids.values()) == set(range(6))
    odd = [(1, 1, 2.5, "Tang", "moon,new,moon", "m", 1), (2, 1, 0.0, None, None, None, 0), (3, 1, 1.0, "Han", "river", "x", 0)]
    df = spark.createDataFrame(odd, "userId long, itemId long, poemStar double, poemDynasty string, poemTagNames string, userSex string, collectAuthor int")
    got = {r["userId"]: r["features"] for r in ranker.assemble(df, terms).collect()}
    marks = {1: {"Tang", "moon", "sex=m"}, 2: set(), 3: {"river"}}
    for u, _, star, *_, favourite in odd:
        cells = {k: v for k, v in {0: star, 1: favourite}.items() if v} | {ids[t] + 2: 1.0 for t in marks[u]}
        assert got[u].size == 8 and dict(zip(got[u].indices.tolist(), got[u].values.tolist())) == cells


def test_a_hundred_thousand_terms(spark):
    """Far more terms than the wide table takes."""
    data = spark.range(50_000).select(
        (F.col("id") % 200).alias("userId"), F.col("id").alias("itemId"), (F.col("id") % 10).cast("double").alias("poemStar"),
        F.concat(F.lit("d"), F.col("id") % 3).alias("poemDynasty"), F.concat(F.lit("a"), F.col("id"), F.lit(",b"), F.col("id")).alias("poemTagNames"),
        F.lit("f").alias("userSex"), F.lit(0).alias("collectAuthor"), (F.col("id") % 10 > 4).cast("int").alias("label"),
    )
    terms = ranker.ranker_terms(data, data)
    assert terms.count() == 100_004
    model = ranker.fit_ranker(data, "lr", terms)
    assert ranker_metrics(model.transform(data)).first()["auc"] > 0.95


def test_unknown_kind(rows, terms):
    with pytest.raises(ValueError):
        ranker.fit_ranker(rows, "svm", terms)


def test_machine_is_that_of_the_estimator(rows, terms, monkeypatch):
    """The same weights as Spark's estimator, in matrices over the places of a block."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import MaxAbsScaler

    df = ranker.assemble(rows, terms).withColumn("label", F.col("label").cast("double"))
    scaled = MaxAbsScaler(inputCol="features", outputCol="scaled").fit(df).transform(df)
    want = FMClassifier(featuresCol="scaled", factorSize=3, maxIter=6, stepSize=0.05, seed=7).fit(scaled)
    size = terms.count() + ranker.TERMS
    told = {}
    for cells in (1 << 20, 7):
        monkeypatch.setattr(machine, "CELLS", cells)
        monkeypatch.setattr(machine, "PACKED", cells)
        model = machine.fit_machine(df, size, "places", "values", factors=3, steps=6)
        scored = df.select("userId", "itemId", model.score("places", "values").alias("score"))
        told[cells] = {(r["userId"], r["itemId"]): r["score"] for r in scored.collect()}
    expected = {(r["userId"], r["itemId"]): float(r["probability"][1]) for r in want.transform(scaled).collect()}
    assert told[7] == pytest.approx(told[1 << 20]) and told[1 << 20] == pytest.approx(expected, abs=1e-6)
    assert max(expected.values()) - min(expected.values()) > 0.01


def test_leaves_and_score_without_a_written_table(rows, terms, monkeypatch):
    """The scores of leaves come from places and values, with no vector and no table of leaves between."""
    model = ranker.fit_ranker(rows, "trees+fm", terms, n_trees=3)
    monkeypatch.setattr(ranker, "vector_table", None)
    told = model.transform(rows)
    assert told.columns == [*rows.columns, "score"] and told.where("score > 0 AND score < 1").count() == rows.count()


@pytest.mark.parametrize("valued", [False, True])
def test_packed_rows_are_small_and_hold_everything(valued):
    """Readers hold thousands of packed rows at once, so one is some kilobytes; empty rows and slices of batches stay."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    places = [sorted(rng.choice(400, n, replace=False).tolist()) for n in rng.integers(0, 60, 5000)] + [[]] * 3000 + [list(range(300))]
    values = [[p / 2 + i for p in row] for i, row in enumerate(places)]
    label = np.arange(len(places)) % 3.0
    batch = pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(label)], ["p", "v", "label"])
    pack = machine._packed("p", "v" if valued else None, "label")
    packed = list(pack([batch.slice(0, 0), batch.slice(0, 700), batch.slice(700)]))
    assert max(sum(len(x) for x in row.values()) for b in packed for row in b.to_pylist()) < 8000
    found = [], [], []
    for b in packed:
        for part in (b.slice(0, 3), b.slice(3)):
            for ends, where, held, told in machine._pieces(part, valued):
                found[0].extend(where[x:y].tolist() for x, y in zip(ends, ends[1:]))
                found[1].extend(held[x:y].tolist() for x, y in zip(ends, ends[1:])) if valued else None
                found[2].extend(told)
    assert found[0] == places and found[1] == (values if valued else []) and found[2] == label.tolist()
