"""Rankers: logistic regression or factorisation machine, alone or on tree leaves."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.functions.parsing import digest, digest_number
from versetide.operators.features import item_terms, number_terms
from versetide.operators.machine import Machine, fit_machine
from versetide.operators.metrics import ranker_metrics
from versetide.operators.vectors import vector_table
from versetide.session import broadcast_if_small, settle, use_checkpoints

KINDS = ("lr", "fm", "trees+lr", "trees+fm")
N_TREES = 50  # fixed value of the encoder
TREE_DEPTH = 3


STAR, FAVOURITE, TERMS = 0, 1, 2  # places of the star and the favourite flag, and of the first term


def ranker_terms(items: DataFrame, users: DataFrame) -> DataFrame:
    """(term, termId), written: dynasties, tags and sexes, any number of them, with ids from 0."""
    sexes = users.where(F.col("userSex").isNotNull()).select(F.concat(F.lit("sex="), F.col("userSex")).alias("term"))
    return number_terms(items.select(F.explode(item_terms()).alias("term")).unionByName(sexes))


def feature_arrays(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Add ``places`` and ``values``: star, favourite flag, and indicators of dynasty, tags and sex.

    Terms are looked up once for each dynasty and tags and for each sex, not for each row. A term
    that ``terms`` does not have is left out, so scoring lines up with training.
    """
    rows, ids = settle(rows, "feature-rows"), broadcast_if_small(terms, 64)
    kinds, place = ["poemDynasty", "poemTagNames"], (F.col("termId") + TERMS).alias("place")
    named = settle(rows.select(*kinds).distinct(), "item-kinds")
    known = named.select(*kinds, F.explode(item_terms()).alias("term")).join(ids, "term").groupBy(*kinds).agg(F.collect_set(place).alias("_item"))
    known = settle(known, "kind-places").select(*(F.col(k).alias(f"_{k}") for k in kinds), "_item")
    sexes = rows.select("userSex").distinct().join(ids, F.concat(F.lit("sex="), F.col("userSex")) == F.col("term"))
    sexes = settle(sexes.select(F.col("userSex").alias("_sex"), F.array(place).alias("_user")), "sex-places")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in kinds]
    joined = rows.join(broadcast_if_small(known, 512), same[0] & same[1], "left").join(
        broadcast_if_small(sexes, 64), F.col("userSex") == F.col("_sex"), "left"
    )
    none = F.array().cast("array<int>")
    marks = F.array_sort(F.concat(F.coalesce("_item", none), F.coalesce("_user", none)))
    # zeros are not stored: estimators take what is stored as not zero
    plain = [(F.lit(STAR), F.col("poemStar").cast("double")), (F.lit(FAVOURITE), F.col("collectAuthor").cast("double"))]
    places = [F.when(v != 0, F.array(k)).otherwise(none) for k, v in plain]
    values = [F.when(v != 0, F.array(v)).otherwise(F.array().cast("array<double>")) for _, v in plain]
    ones = F.transform("_marks", lambda _: F.lit(1.0))
    return joined.withColumn("_marks", marks).select(
        *rows.columns, F.concat(*places, F.col("_marks")).alias("places"), F.concat(*values, ones).alias("values")
    )


def assemble(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` written with ``places``, ``values`` and the sparse vector ``features`` of them."""
    return vector_table(feature_arrays(rows, terms), "places", "values", terms.count() + TERMS, "features", "assembled")


def fit_leaf_encoder(df: DataFrame, n_trees: int = N_TREES, depth: int = TREE_DEPTH, seed: int = 7):
    """Boosted trees whose ``leaf`` column holds the leaf reached in each tree."""
    use_checkpoints(df.sparkSession)
    return GBTClassifier(
        maxIter=n_trees, maxDepth=depth, seed=seed, leafCol="leaf", featuresCol="features", labelCol="label",
        predictionCol="_treePrediction", checkpointInterval=10,
    ).setRawPredictionCol("_treeRaw").setProbabilityCol("_treeProbability").fit(df)


# (place, threshold, below or at, above), or None for a leaf
Node = tuple | None
# tree, number of the leaf in it, and for each place that its path tests the bounds: above the first, at most the second
Path = tuple[int, int, dict[int, tuple[float, float]]]


def leaf_paths(trees: list[Node]) -> list[Path]:
    """One path for each leaf, in the order of the leaves from left to right."""
    paths: list[Path] = []
    for tree, root in enumerate(trees):
        waiting, number = [(root, {})], 0
        while waiting:
            node, bounds = waiting.pop()
            if node is None:
                paths.append((tree, number, bounds))
                number += 1
                continue
            place, cut, left, right = node
            low, high = bounds.get(place, (-math.inf, math.inf))
            waiting.append((right, bounds | {place: (max(low, cut), high)}))
            waiting.append((left, bounds | {place: (low, min(high, cut))}))
    return paths


def fitted_trees(model: GBTClassificationModel) -> list[Node]:
    """The trees of a fitted model: a few nodes each."""
    def read(node) -> Node:
        if node.getClass().getSimpleName() == "LeafNode":
            return None
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(tree._java_obj.rootNode()) for tree in model.trees]


def leaf_slots(df: DataFrame, trees: list[Node], width: int) -> DataFrame:
    """Add ``slots``: for each tree ``tree * width`` and the number of the leaf that ``places`` and ``values`` lead to.

    Each leaf is a range for every place on its path. A batch lists the values of the
    tested places and compares them with the ranges. A place that is not there is 0.
    """
    paths = leaf_paths(trees)
    tested = np.array(sorted({place for _, _, bounds in paths for place in bounds}), np.int64)
    column = {int(place): i for i, place in enumerate(tested)}

    def slots(places: pa.Array, values: pa.Array) -> pa.Array:
        n = len(places)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))
        place, value = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, values))
        told = np.zeros((len(tested), n))
        if len(tested):
            at = np.minimum(np.searchsorted(tested, place), len(tested) - 1)
            met = tested[at] == place
            told[at[met], row[met]] = value[met]
        found = np.zeros((n, len(trees)), np.int32)
        for tree, number, bounds in paths:
            inside = np.ones(n, bool)
            for p, (low, high) in bounds.items():
                if low > -math.inf:
                    inside &= ~(told[column[p]] <= low)  # above, and what is not a number is above all
                if high < math.inf:
                    inside &= told[column[p]] <= high
            found[inside, tree] = tree * width + number
        ends = np.arange(n + 1, dtype=np.int32) * len(trees)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.withColumn("slots", F.arrow_udf(slots, "array<int>")("places", "values"))


def encode_leaves(trees: GBTClassificationModel, df: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """``df`` written with the one-hot leaves as ``features``, one place per tree and leaf.

    The places follow from the number of trees and their depth, so rows encoded
    at any time have the same columns.
    """
    width = 1 << depth
    told = leaf_slots(df, fitted_trees(trees), width).withColumn("_ones", F.transform("slots", lambda _: F.lit(1.0)))
    return vector_table(told, "slots", "_ones", len(trees.trees) * width, "features", "leaves").drop("slots", "_ones")


@dataclass
class Ranker:
    """A fitted ranker with the terms it was fitted on."""

    kind: str
    terms: DataFrame  # term, termId
    final: PipelineModel | Machine
    trees: GBTClassificationModel | None = None
    depth: int = TREE_DEPTH
    dropped: list[str] = field(
        default_factory=lambda: ["features", "places", "values", "slots", "scaled", "rawPrediction", "probability", "prediction"]
    )

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``score``, the probability of label 1, to rows of ``ranker_rows``."""
        # only the plain regression reads the vector
        return self.score(assemble(rows, self.terms) if self.kind == "lr" else feature_arrays(rows, self.terms))

    def score(self, assembled: DataFrame) -> DataFrame:
        """As ``transform``, on rows that have ``places`` and ``values`` already, and ``features`` for ``lr``."""
        if self.kind == "trees+fm":
            told = leaf_slots(assembled, fitted_trees(self.trees), 1 << self.depth)
            return told.withColumn("score", self.final.score("slots")).drop(*self.dropped)
        if self.kind == "fm":
            return assembled.withColumn("score", self.final.score("places", "values")).drop(*self.dropped)
        df = encode_leaves(self.trees, assembled, self.depth) if self.trees is not None else assembled
        told = self.final.transform(df).withColumn("score", vector_to_array("probability")[1])
        return told.drop(*self.dropped)

    def save(self, path: str) -> None:
        """Write the parts of the model under ``path``."""
        spark = SparkSession.getActiveSession()
        self.final.save(f"{path}/final")
        if self.trees is not None:
            self.trees.save(f"{path}/trees")
        self.terms.write.parquet(f"{path}/terms")
        spark.createDataFrame([(self.kind, self.depth)], "kind string, depth int").write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ranker":
        """Read a saved ranker."""
        about = spark.read.parquet(f"{path}/about").first()
        trees = GBTClassificationModel.load(f"{path}/trees") if about["kind"].startswith("trees") else None
        final = Machine.load(spark, f"{path}/final") if about["kind"].endswith("fm") else PipelineModel.load(f"{path}/final")
        return Ranker(about["kind"], spark.read.parquet(f"{path}/terms"), final, trees, about["depth"])


def _regression() -> Pipeline:
    scaler = MaxAbsScaler(inputCol="features", outputCol="scaled")
    return Pipeline(stages=[scaler, LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=50, regParam=0.01)])


def fit_ranker(
    rows: DataFrame, kind: str, terms: DataFrame, n_trees: int = N_TREES,
    depth: int = TREE_DEPTH, seed: int = 7, trees: GBTClassificationModel | None = None,
) -> Ranker:
    """Fit one kind of ranker on rows of ``ranker_rows`` with a ``label``, or on assembled ones."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    df = rows if "features" in rows.columns else assemble(rows, terms)
    if not kind.startswith("trees"):
        if kind == "fm":
            return Ranker(kind, terms, fit_machine(df, terms.count() + TERMS, "places", "values", seed=seed), None, depth)
        return Ranker(kind, terms, _regression().fit(df.select("features", "label")), None, depth)
    trees = trees or fit_leaf_encoder(df, n_trees, depth, seed)
    df = df.select("places", "values", "label")
    if kind == "trees+fm":
        width = 1 << depth
        told = leaf_slots(df, fitted_trees(trees), width).select("slots", "label")
        # on leaves every tree sets a slot, so a row moves many weights and steps are smaller
        final = fit_machine(told, len(trees.trees) * width, "slots", steps=25, step_size=0.01, seed=seed)
    else:
        final = _regression().fit(encode_leaves(trees, df, depth).select("features", "label"))
    return Ranker(kind, terms, final, trees, depth)


def split_rows(rows: DataFrame, share: int = 20, seed: int = 11) -> DataFrame:
    """Add ``held``: true for about ``share`` percent of the pairs, chosen by digest."""
    return rows.withColumn("held", digest_number(digest(seed, "userId", "itemId")) % 100 < share)


def compare_rankers(
    rows: DataFrame, terms: DataFrame, kinds=KINDS, n_trees: int = N_TREES,
    depth: int = TREE_DEPTH, seed: int = 7,
) -> DataFrame:
    """(kind, auc, logloss) of each kind on the held-out pairs."""
    parts = assemble(split_rows(rows).withColumn("label", F.col("label").cast("double")), terms).select(
        "features", "places", "values", "label", "held"
    )
    train, test = parts.where(~F.col("held")).drop("held"), parts.where("held").drop("held")
    trees = fit_leaf_encoder(train, n_trees, depth, seed) if any(k.startswith("trees") for k in kinds) else None
    scored = None
    for kind in kinds:
        ranker = fit_ranker(train, kind, terms, n_trees, depth, seed, trees)
        one = settle(ranker.score(test).select(F.lit(kind).alias("kind"), "label", "score"), "scored")
        scored = one if scored is None else scored.unionByName(one)
    return ranker_metrics(scored, "kind").select("kind", "auc", "logloss")
