"""The offline job: access log to the two sample sets and the training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from versetide.operators.events import clean_log, engagement_ratings, score_events
from versetide.operators.features import training_set
from versetide.operators.samples import add_negatives
from versetide.session import settle


@dataclass
class OfflineResult:
    """``actions`` trains the factorisation (no negatives), ``samples`` the ranker."""

    actions: DataFrame
    samples: DataFrame
    training: DataFrame


def user_log(log: DataFrame) -> DataFrame:
    """(userId, itemId, rating, label) of an access log."""
    return engagement_ratings(score_events(clean_log(log)))


def offline_job(
    log: DataFrame, users: DataFrame, items: DataFrame, favourites: DataFrame, impressions: DataFrame,
    pos_per_neg: int = 1, seed=0,
) -> OfflineResult:
    """Run the whole preprocessing; ``items`` is the wide one-hot table."""
    actions = settle(user_log(log), "user-log")
    samples = settle(add_negatives(actions, impressions, pos_per_neg, seed=seed), "samples")
    return OfflineResult(actions, samples, training_set(samples, items, users, favourites))
