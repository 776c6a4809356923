"""The three services, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import digest
from versetide.operators.features import ranker_rows
from versetide.operators.ranking import to_lists, top_k
from versetide.operators.recall import DEFAULT_TAGS, SIMILAR_USED, recall
from versetide.session import spread

SHOWN = 10  # fixed value: length of the answer


def rank_candidates(scored: DataFrame, k: int = SHOWN) -> DataFrame:
    """(userId, itemId, score, rank): the ``k`` best scored candidates of each user."""
    return top_k(scored.select("userId", "itemId", "score"), ["userId"], [F.desc("score"), F.col("itemId")], k)


def guess_you_like(
    users: DataFrame, recent: DataFrame, similar: DataFrame, index: DataFrame, items: DataFrame,
    user_info: DataFrame, favourites: DataFrame, ranker, defaults=DEFAULT_TAGS, k: int = SHOWN, seed=0,
) -> DataFrame:
    """(userId, itemId, score, rank): recall, features, ranking.

    ``ranker.transform`` adds ``score``. Every user and every candidate stays,
    whatever is known about them.
    The candidates are written before the costly scoring, in parts for every core.
    """
    candidates = spread(recall(users, recent, similar, index, defaults, seed), "candidates")
    return rank_candidates(ranker.transform(ranker_rows(candidates, items, user_info, favourites, serving=True)), k)


def shown_lists(ranked: DataFrame) -> DataFrame:
    """(userId, items) of ranked rows."""
    return to_lists(ranked, "userId", "itemId")


def most_similar(similar: DataFrame, k: int = SIMILAR_USED) -> DataFrame:
    """(poemId, items): the head of each stored list."""
    return similar.select("poemId", F.slice("top100", 1, k).alias("items"))


def daily_list(recommendations: DataFrame, day: str, n: int = SHOWN) -> DataFrame:
    """(userId, itemId, rank): ``n`` of each user's stored list, another draw every day."""
    drawn = recommendations.select("userId", "itemId", digest(day, "userId", "itemId").alias("_digest"))
    return top_k(drawn, ["userId"], [F.col("_digest"), F.col("itemId")], n).drop("_digest")


def daily_for(users: DataFrame, daily: DataFrame) -> DataFrame:
    """(userId, items): the daily list of each asked user, null for an unknown one."""
    return users.select("userId").join(daily, "userId", "left")
