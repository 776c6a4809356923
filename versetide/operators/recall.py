"""Recent activity, tag index and candidate recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import digest, digest_number, entry_item, entry_tags
from versetide.operators.features import item_terms, lookup
from versetide.operators.ranking import dense_positions, sample_per_group, to_lists, top_k

# Fixed values of the service.
RECENT_ENTRIES = 11
SIMILAR_USED = 10
TAGS_DRAWN = 5
ITEMS_PER_TAG = 5
DEFAULT_TAGS = ("唐代", "近代", "初中古诗")


def last_actions(events: DataFrame, n: int = RECENT_ENTRIES) -> DataFrame:
    """The last ``n`` rows of each user by (ts, eventId), newest first, with ``rank``."""
    return top_k(events, ["userId"], [F.desc("ts"), F.desc("eventId")], n)


def recent_activity(events: DataFrame, items: DataFrame, n: int = RECENT_ENTRIES) -> DataFrame:
    """(userId, recent): entries of the last ``n`` actions, newest first.

    The cut comes before the join with the items.
    """
    return to_lists(activity_entries(last_actions(events, n), items), "userId", "entry", name="recent")


def activity_entries(actions: DataFrame, items: DataFrame) -> DataFrame:
    """Actions with ``entry``: ``<item>-dynasty-tag...`` or ``NoPoemID`` without item."""
    terms = lookup(items.select(F.col("poemId").alias("_item"), F.array_join(item_terms(), "-").alias("_terms")), "_item")
    head = F.coalesce(F.col("itemId").cast("string"), F.lit("NoPoemID"))
    return (
        actions.join(terms, F.col("itemId") == F.col("_item"), "left")
        .withColumn("entry", F.concat_ws("-", head, F.col("_terms")))
        .drop("_item", "_terms")
    )


def parse_activity(recent: DataFrame, n: int = RECENT_ENTRIES) -> DataFrame:
    """(userId, pos, itemId, tags), one row per entry among the first ``n``."""
    entries = recent.select("userId", F.posexplode(F.slice("recent", 1, n)).alias("pos", "entry"))
    return entries.select(
        "userId", "pos", entry_item(F.col("entry")).alias("itemId"), entry_tags(F.col("entry")).alias("tags")
    )


def user_tags(users: DataFrame, parsed: DataFrame, k: int = TAGS_DRAWN, seed=0) -> DataFrame:
    """(userId, tag): up to ``k`` of each user's recent tags."""
    tags = parsed.select("userId", F.explode("tags").alias("tag")).distinct()
    return sample_per_group(tags.join(users.select("userId"), "userId", "left_semi"), ["userId"], "tag", k, seed)


def with_default_tags(users: DataFrame, tags: DataFrame, defaults=DEFAULT_TAGS) -> DataFrame:
    """Give users without any tag the default ones."""
    cold = users.select("userId").join(tags.select("userId"), "userId", "left_anti")
    given = F.explode(F.array(*[F.lit(t) for t in defaults]))
    return tags.select("userId", "tag").unionByName(cold.select("userId", given.alias("tag")))


def tag_index(items: DataFrame, seed=0) -> DataFrame:
    """(tag, pos, itemId, n): the items of each tag in hash order, ``n`` in all.

    One row per pair, since a list of a common tag would not fit one row.
    """
    pairs = items.select(
        F.explode(item_terms()).alias("tag"), F.col("poemId").alias("itemId")
    ).distinct()
    return dense_positions(
        pairs.withColumn("_digest", digest(seed, "tag", "itemId")), ["tag"], "_digest", "itemId"
    ).select("tag", "pos", "itemId", "n")


def tag_lists(index: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(tag, chunk, items, n): the index as arrays of at most ``chunk`` items."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "itemId"))).getField("itemId")
    return index.groupBy("tag", F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        ordered.alias("items"), F.first("n").alias("n")
    )


def draw_tag_items(tags: DataFrame, index: DataFrame, k: int = ITEMS_PER_TAG, seed=0) -> DataFrame:
    """(userId, itemId): ``k`` items per (user, tag), all of them when there are fewer.

    The index is in hash order, so ``k`` neighbours from a start that depends on
    the user and the tag are a draw without replacement. Each draw asks for its
    rows by (tag, pos): no user meets a whole tag. Pass the index as a written
    table; the default tags are asked for by many users, and the adaptive
    planner splits such a key.
    """
    sizes = index.where(F.col("pos") == 0).select("tag", "n")
    start = digest_number(digest(seed, "userId", "tag")) % F.col("n")
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n"), F.lit(k)) - 1)
    asked = (
        tags.join(sizes, "tag")
        .withColumn("_start", start)
        .select("userId", "tag", "n", "_start", F.explode(steps).alias("_step"))
        .select("userId", "tag", ((F.col("_start") + F.col("_step")) % F.col("n")).alias("pos"))
    )
    return asked.join(index.select("tag", "pos", "itemId"), ["tag", "pos"]).select("userId", "itemId")


def similar_to_recent(parsed: DataFrame, similar: DataFrame, k: int = SIMILAR_USED) -> DataFrame:
    """(userId, itemId): the first ``k`` similar items of each recent item."""
    seen = parsed.where(F.col("itemId").isNotNull()).select("userId", F.col("itemId").alias("poemId")).distinct()
    lists = lookup(similar.select("poemId", F.slice("top100", 1, k).alias("_near")), "poemId")
    return seen.join(lists, "poemId").select("userId", F.explode("_near").alias("itemId"))


def recall(
    users: DataFrame,
    recent: DataFrame,
    similar: DataFrame,
    index: DataFrame,
    defaults=DEFAULT_TAGS,
    seed=0,
    n_tags: int = TAGS_DRAWN,
    n_items: int = ITEMS_PER_TAG,
    n_similar: int = SIMILAR_USED,
    fixed: DataFrame | None = None,
) -> DataFrame:
    """(userId, itemId): distinct candidates of every user from all recalls.

    ``fixed`` is a stored list per user, (userId, itemId) rows such as those of
    ``save_cf_lists``; it is a third source. ``recent`` and ``index`` are read
    more than once: pass written tables.
    """
    parsed = parse_activity(recent)
    wanted = users.select("userId")
    tags = with_default_tags(users, user_tags(users, parsed, n_tags, seed), defaults)
    by_text = similar_to_recent(parsed.join(wanted, "userId", "left_semi"), similar, n_similar)
    by_tag = draw_tag_items(tags, index, n_items, seed)
    as_long = [F.col("userId").cast("bigint").alias("userId"), F.col("itemId").cast("bigint").alias("itemId")]
    found = by_text.select(*as_long).unionByName(by_tag.select(*as_long))
    if fixed is not None:
        found = found.unionByName(fixed.select(*as_long).join(wanted, "userId", "left_semi"))
    return found.dropDuplicates(["userId", "itemId"])
