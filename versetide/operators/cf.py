"""Biased matrix factorisation: mean, biases, and ALS on what is left.

A prediction is ``mean + user bias + item bias + p.q``, clipped to the rating
scale. Unknown users and items fall back to the parts that are known.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.functions.parsing import digest, digest_number
from versetide.operators import als
from versetide.operators.products import top_products
from versetide.operators.ranking import dense_positions
from versetide.session import broadcast_if_small, settle, spread, use_checkpoints

# Fixed values of the rating scale and of the tuning grid.
SCALE = (-2.0, 5.0)
GRID = {
    "rank": list(range(20, 110, 10)),
    "max_iter": list(range(10, 30, 2)),
    "reg": [0.02, 0.1, 0.6, 1, 2, 3, 4, 5],
}
FOLDS = 5
CF_LIST = 100
# Damping of the bias estimates: ratings worth of prior for an item and a user.
ITEM_DAMPING = 10.0
USER_DAMPING = 15.0
INT_MAX = 2**31 - 1


def clip(value: Column, scale=SCALE) -> Column:
    """Limit a prediction to the rating scale."""
    return F.greatest(F.lit(float(scale[0])), F.least(F.lit(float(scale[1])), value))


def known_ratings(log: DataFrame) -> DataFrame:
    """(userId, itemId, rating) of the rows that have all three."""
    return log.select(
        F.col("userId").cast("bigint").alias("userId"),
        F.col("itemId").cast("bigint").alias("itemId"),
        F.col("rating").cast("double").alias("rating"),
    ).dropna("any")


@dataclass
class Biases:
    """Mean rating and the damped offsets of items and users."""

    mean: float
    items: DataFrame  # itemId, itemBias
    users: DataFrame  # userId, userBias

    def add(self, pairs: DataFrame) -> DataFrame:
        """Add ``base`` = mean + user bias + item bias to (userId, itemId) rows."""
        joined = pairs.join(self.users, "userId", "left").join(self.items, "itemId", "left")
        base = F.lit(self.mean) + F.coalesce("userBias", F.lit(0.0)) + F.coalesce("itemBias", F.lit(0.0))
        return joined.withColumn("base", base).drop("userBias", "itemBias")


def fit_biases(ratings: DataFrame, item_damping: float = ITEM_DAMPING, user_damping: float = USER_DAMPING) -> Biases:
    """Damped item offsets from the mean, then user offsets from what is left.

    Offsets are rounded to 10 places: equal ones then tie whatever the order of
    the sums was.
    """
    mean = ratings.agg(F.avg("rating")).first()[0] or 0.0
    count = F.count(F.lit(1))
    items = settle(
        ratings.groupBy("itemId").agg(
            F.round(F.sum(F.col("rating") - mean) / (F.lit(item_damping) + count), 10).alias("itemBias")
        ),
        "item-bias",
    )
    left = F.col("rating") - mean - F.col("itemBias")
    users = settle(
        ratings.join(items, "itemId").groupBy("userId").agg(
            F.round(F.sum(left) / (F.lit(user_damping) + count), 10).alias("userBias")
        ),
        "user-bias",
    )
    return Biases(mean, items, users)


def baseline_top(biases: Biases, k: int = CF_LIST, scale=SCALE) -> DataFrame:
    """(userId, itemId, rank, score) of the bias model alone.

    Within one user the order is that of the item biases, so the same ``k``
    items, a bounded array, serve all users and nothing is crossed.
    """
    best = biases.items.orderBy(F.desc("itemBias"), "itemId").limit(k).agg(
        F.sort_array(F.collect_list(F.struct(-F.col("itemBias"), F.col("itemId")))).alias("best")
    ).first()["best"]
    if not best:
        return biases.users.select("userId", F.lit(0).cast("bigint").alias("itemId"),
                                   F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(row["itemId"]).cast("bigint").alias("itemId"),
                 F.lit(-row[0]).alias("itemBias"))
        for i, row in enumerate(best)
    ])
    return biases.users.select("userId", "userBias", F.explode(listed).alias("e")).select(
        "userId", "e.itemId", "e.rank",
        clip(F.lit(biases.mean) + F.col("userBias") + F.col("e.itemBias"), scale).alias("score"),
    )


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a distinct id of each key from 0, for estimators that want ints."""
    keys = df.select(key).distinct().withColumn("_digest", digest("id", key))
    return dense_positions(keys, [], "_digest", key).select(key, F.col("pos").cast("int").alias(name))


@dataclass
class CFModel:
    """Mean, biases and factors; tables are keyed by the original ids."""

    mean: float
    users: DataFrame  # userId, userBias, p
    items: DataFrame  # itemId, itemBias, q
    scale: tuple[float, float] = SCALE

    def transform(self, pairs: DataFrame) -> DataFrame:
        """Add ``prediction`` to (userId, itemId) rows."""
        joined = pairs.join(self.users, "userId", "left").join(self.items, "itemId", "left")
        dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        known = F.lit(self.mean) + F.coalesce("userBias", F.lit(0.0)) + F.coalesce("itemBias", F.lit(0.0))
        return joined.withColumn("prediction", clip(known + F.coalesce(dot, F.lit(0.0)), self.scale)).drop(
            "userBias", "itemBias", "p", "q"
        )

    def save(self, path: str) -> None:
        """Write the model as tables under ``path``."""
        spark = self.users.sparkSession
        self.users.write.parquet(f"{path}/users")
        self.items.write.parquet(f"{path}/items")
        spark.createDataFrame([(self.mean, *self.scale)], "mean double, low double, high double").write.parquet(
            f"{path}/scalars"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CFModel":
        """Read a saved model."""
        row = spark.read.parquet(f"{path}/scalars").first()
        return CFModel(row["mean"], spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"),
                       (row["low"], row["high"]))


def _fits_int(df: DataFrame, *keys: str) -> bool:
    bounds = df.agg(*[f(k).alias(f"{k}_{n}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return all(bounds[f"{k}_lo"] is None or (bounds[f"{k}_lo"] >= 0 and bounds[f"{k}_hi"] <= INT_MAX) for k in keys)


def _als(rank: int, max_iter: int, reg: float, seed: int, blocks: int) -> ALS:
    return ALS(
        rank=rank, maxIter=max_iter, regParam=reg, seed=seed, numUserBlocks=blocks, numItemBlocks=blocks,
        userCol="u", itemCol="i", ratingCol="left", coldStartStrategy="nan", checkpointInterval=5,
    )


def fit_cf(ratings: DataFrame, rank: int = 20, max_iter: int = 10, reg: float = 0.1, seed: int = 7,
           blocks: int | None = None) -> CFModel:
    """Fit on (userId, itemId, rating) with one row per pair.

    ALS wants int keys: ids in int range are used as they are, others go
    through a dense id table that is built without a global sort.
    """
    spark = ratings.sparkSession
    use_checkpoints(spark)
    ratings = spread(known_ratings(ratings), "ratings")
    biases = fit_biases(ratings)
    left = biases.add(ratings).withColumn("left", F.col("rating") - F.col("base"))
    plain = _fits_int(ratings, "userId", "itemId")
    if plain:
        keyed = left.select(F.col("userId").cast("int").alias("u"), F.col("itemId").cast("int").alias("i"), "left")
    else:
        user_ids = settle(dense_ids(ratings, "userId", "u"), "user-ids")
        item_ids = settle(dense_ids(ratings, "itemId", "i"), "item-ids")
        keyed = left.join(user_ids, "userId").join(item_ids, "itemId").select("u", "i", "left")
    model = _als(rank, max_iter, reg, seed, blocks or spark.sparkContext.defaultParallelism).fit(keyed)

    def side(factors: DataFrame, bias: DataFrame, ids, key: str, short: str, vector: str) -> DataFrame:
        values = factors.select(F.col("id"), F.col("features").cast("array<double>").alias(vector))
        if plain:
            named = values.select(F.col("id").cast("bigint").alias(key), vector)
        else:
            named = values.join(ids, values["id"] == ids[short]).select(key, vector)
        return settle(bias.join(named, key, "left"), f"{key}-factors")

    return CFModel(
        biases.mean,
        side(model.userFactors, biases.users, None if plain else user_ids, "userId", "u", "p"),
        side(model.itemFactors, biases.items, None if plain else item_ids, "itemId", "i", "q"),
    )


def recommend_all(model: CFModel, k: int = CF_LIST, **blocks) -> DataFrame:
    """(userId, itemId, rank, score): the ``k`` best items of every user; seen ones stay.

    The item bias joins the item vector and a constant 1 the user vector, so
    that one inner product ranks by bias and factors together.
    """
    users = model.users.select(
        F.col("userId").alias("id"), F.concat("p", F.array(F.lit(1.0))).alias("vec")
    )
    items = model.items.select(
        F.col("itemId").alias("id"), F.concat("q", F.array(F.col("itemBias"))).alias("vec")
    )
    best = top_products(users, items, k, **blocks)
    score = F.lit(model.mean) + F.col("userBias") + F.col("score")
    return (
        best.join(broadcast_if_small(model.users.select(F.col("userId").alias("id"), "userBias"), 64), "id")
        .select(F.col("id").alias("userId"), F.col("target").alias("itemId"), "rank",
                clip(score, model.scale).alias("score"))
    )


def fit_sums(ratings: DataFrame, rank: int = 20, max_iter: int = 10, reg: float = 0.1) -> CFModel:
    """As ``fit_cf``, with factors from additive normal equations: any keys, and no hot one in one task."""
    ratings = spread(known_ratings(ratings), "ratings")
    biases = fit_biases(ratings)
    left = biases.add(ratings).withColumn("left", F.col("rating") - F.col("base"))
    users, items = als.fit(left, rank, max_iter, reg)
    sides = (biases.users, users, "userId", "p"), (biases.items, items, "itemId", "q")
    named = [settle(b.join(v.select(F.col("id").alias(k), F.col("vec").alias(name)), k, "left"), f"{k}-factors") for b, v, k, name in sides]
    return CFModel(biases.mean, *named)


def save_cf_lists(recommendations: DataFrame, path: str) -> None:
    """Store the per-user lists as the fixed recall set."""
    recommendations.write.mode("overwrite").parquet(path)


def with_folds(ratings: DataFrame, folds: int = FOLDS, seed: int = 7) -> DataFrame:
    """Add ``fold`` by the digest of the pair: the same rows get the same fold in any run."""
    return ratings.withColumn("fold", (digest_number(digest(seed, "userId", "itemId")) % folds).cast("int"))


def fold_errors(ratings: DataFrame, folds: int = FOLDS, seed: int = 7, scale=SCALE) -> DataFrame:
    """(fold, n, rmse, mae) of the bias model, each fold predicted from the others.

    One row for each fold; a fold without ratings has none.
    """
    rows = settle(with_folds(known_ratings(ratings), folds, seed), "folds")
    out = None
    for fold in range(folds):
        test = rows.where(F.col("fold") == fold)
        miss = F.col("rating") - clip(F.col("base"), scale)
        one = fit_biases(rows.where(F.col("fold") != fold)).add(test).groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae")
        )
        out = one if out is None else out.unionByName(one)
    return out


def tune_cf(ratings: DataFrame, grid: dict[str, list] | None = None, folds: int = FOLDS, seed: int = 7,
            parallelism: int = 4) -> DataFrame:
    """(rank, max_iter, reg, rmse, mae, best): mean errors over the folds of each setting.

    The biases do not depend on the setting, so each fold fits them once; the
    settings of a fold then train side by side. Only the errors reach the driver.
    """
    spark = ratings.sparkSession
    use_checkpoints(spark)
    grid = grid or GRID
    settings = list(product(grid["rank"], grid["max_iter"], grid["reg"]))
    errors: dict[tuple, list[tuple[float, float]]] = {s: [] for s in settings}
    rows = settle(with_folds(known_ratings(ratings), folds, seed), "folds")
    if not _fits_int(rows, "userId", "itemId"):
        users = dense_ids(rows, "userId", "u")
        items = dense_ids(rows, "itemId", "i")
        rows = settle(rows.join(users, "userId").join(items, "itemId"), "folds-keyed")
    else:
        rows = rows.withColumns({"u": F.col("userId").cast("int"), "i": F.col("itemId").cast("int")})
    blocks = spark.sparkContext.defaultParallelism
    for fold in range(folds):
        train_rows = rows.where(F.col("fold") != fold)
        biases = fit_biases(train_rows)
        based = settle(biases.add(rows).select("u", "i", "rating", "base", "fold"), "fold-base")
        train = based.where(F.col("fold") != fold).withColumn("left", F.col("rating") - F.col("base"))
        test = based.where(F.col("fold") == fold)

        def run(setting):
            model = _als(*setting, seed, blocks).fit(train)
            guess = clip(F.col("base") + F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)))
            miss = F.col("rating") - guess
            row = model.transform(test).agg(F.sqrt(F.avg(miss * miss)), F.avg(F.abs(miss))).first()
            return setting, (row[0], row[1])

        with ThreadPool(parallelism) as pool:
            for setting, pair in pool.map(run, settings):
                errors[setting].append(pair)
    scored = []
    for setting in settings:
        pairs = [p for p in errors[setting] if p[0] is not None]
        if not pairs:
            continue  # no fold of this setting had a rating to predict
        scored.append((*setting, sum(p[0] for p in pairs) / len(pairs), sum(p[1] for p in pairs) / len(pairs)))
    least = min((s[3] for s in scored), default=None)
    first_best = next((i for i, s in enumerate(scored) if s[3] == least), None)
    return spark.createDataFrame(
        [(r, m, float(g), rmse, mae, i == first_best) for i, (r, m, g, rmse, mae) in enumerate(scored)],
        "rank int, max_iter int, reg double, rmse double, mae double, best boolean",
    )


def sweep_cf(ratings: DataFrame, grid: dict[str, list] | None = None, folds: int = FOLDS, seed: int = 7, scale=SCALE) -> DataFrame:
    """(rank, max_iter, reg, rmse, mae, best): mean errors over the folds of each setting, in one sweep for each rank.

    A sweep carries all regularisations in all folds, each vector row holding one
    for each of them, and goes on to the largest ``max_iter``; errors are taken on
    the way, at every one of the grid. Rows without a fold's ratings in training
    count with the parts that are known, as in ``CFModel``. The first setting of
    the least error is ``best``.
    """
    spark = ratings.sparkSession
    grid = grid or GRID
    rows = settle(with_folds(known_ratings(ratings), folds, seed), "folds")
    based = rows
    for fold in range(folds):
        based = fit_biases(rows.where(F.col("fold") != fold)).add(based).withColumnRenamed("base", f"base_{fold}")
    values = F.array(*(F.col("rating") - F.col(f"base_{f}") for f in range(folds)), *(F.col(f"base_{f}") for f in range(folds)))
    based = settle(based.select("userId", "itemId", "fold", values.alias("values")), "fold-bases")
    by_user, by_item = als.blocks(based, "userId", "itemId"), als.blocks(based, "itemId", "userId")
    settings = [als.Setting(float(reg), fold) for reg in grid["reg"] for fold in range(folds)]
    ids = settle(by_item.select("key").distinct(), "item-ids")
    scored = []
    for rank in grid["rank"]:
        items = settle(als.first_vectors(ids, "key", rank, len(settings)), "first-vectors")
        for step in range(1, max(grid["max_iter"]) + 1):
            users = als.half_step(by_user, items, rank, settings, 2 * folds)
            items = als.half_step(by_item, users, rank, settings, 2 * folds)
            if step not in grid["max_iter"]:
                continue
            found = {r["setting"]: r for r in als.errors(by_user, users, items, rank, settings, 2 * folds, scale).collect()}
            for i, reg in enumerate(grid["reg"]):
                seen = [r for r in (found.get(i * folds + f) for f in range(folds)) if r and r["n"]]
                if seen:
                    rmse = sum((r["squares"] / r["n"]) ** 0.5 for r in seen) / len(seen)
                    mae = sum(r["distances"] / r["n"] for r in seen) / len(seen)
                    scored.append((rank, step, float(reg), rmse, mae))
    least = min((s[3] for s in scored), default=None)
    best = next((i for i, s in enumerate(scored) if s[3] == least), None)
    return spark.createDataFrame(
        [(*s, i == best) for i, s in enumerate(scored)], "rank int, max_iter int, reg double, rmse double, mae double, best boolean"
    )


def fit_best(ratings: DataFrame, tuned: DataFrame) -> CFModel:
    """The model of the best setting of ``sweep_cf``, fitted on all ratings."""
    best = tuned.where("best").first()
    if best is None:
        raise ValueError("no setting could be scored")
    return fit_sums(ratings, best["rank"], best["max_iter"], best["reg"])
