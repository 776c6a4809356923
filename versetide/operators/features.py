"""Item, user and favourite-author features."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import digest, tag_list
from versetide.operators.ranking import dense_positions
from versetide.session import settle

AUTHOR_OFFSET = 200000  # fixed value: keeps author ids apart from poem ids
MAX_VOCABULARY = 1 << 16


def item_terms(dynasty: str = "poemDynasty", tags: str = "poemTagNames") -> Column:
    """Distinct dynasty and tags of an item."""
    terms = F.array_union(F.array(F.col(dynasty)), tag_list(F.col(tags)))
    return F.array_distinct(F.array_compact(terms))


def feature_vocab(items: DataFrame, max_size: int = MAX_VOCABULARY) -> list[str]:
    """Dynasties and tags in order: the indicator columns.

    Models keep one coefficient per entry, so a vocabulary above ``max_size``
    is an error and not cut.
    """
    terms = items.select(F.explode(item_terms()).alias("term")).distinct()
    rows = terms.limit(max_size + 1).collect()
    if len(rows) > max_size:
        raise ValueError(f"more than {max_size} distinct dynasties and tags")
    return sorted(row["term"] for row in rows)


def multi_hot(items: DataFrame, vocab: list[str], output: str = "indicators") -> DataFrame:
    """Add a 0/1 vector over ``vocab``: 1 for the item's dynasty and tags."""
    model = CountVectorizerModel.from_vocabulary(vocab, "_terms", output, binary=True)
    return model.transform(items.withColumn("_terms", item_terms())).drop("_terms")


def one_hot_table(items: DataFrame, vocab: list[str]) -> DataFrame:
    """Item table with one 0/1 column per vocabulary entry."""
    terms = item_terms()
    keep = [c for c in items.columns if c != "poemTagNames"]
    return items.select(*keep, *[F.array_contains(terms, v).cast("int").alias(v) for v in vocab])


def term_table(items: DataFrame) -> DataFrame:
    """(term, termId) of all dynasties and tags, with ids from 0, for any number of terms."""
    return number_terms(items.select(F.explode(item_terms()).alias("term")))


def number_terms(terms: DataFrame) -> DataFrame:
    """(term, termId), written, of the distinct terms of ``terms``, in the order of their digests."""
    terms = terms.distinct()
    ids = dense_positions(terms.withColumn("_digest", digest("term", "term")), [], "_digest", "term")
    return settle(ids.select("term", F.col("pos").cast("int").alias("termId")), "terms")


def item_indicators(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(poemId, indicators): ids of an item's terms in order, the places of its ones."""
    rows = items.select(F.col("poemId").try_cast("int").alias("poemId"), F.explode(item_terms()).alias("term"))
    return rows.join(terms, "term").groupBy("poemId").agg(F.sort_array(F.collect_set("termId")).alias("indicators"))


def sparse_training_set(
    log: DataFrame, items: DataFrame, users: DataFrame, favourites: DataFrame, terms: DataFrame
) -> DataFrame:
    """Training rows with the indicators of an item as term ids, whatever its terms are called.

    ``items`` is the attribute table and ``terms`` its ``term_table``. Rows are
    those of ``training_set``; an item without terms has an empty list.
    """
    joined = join_items(log, items.drop("poemTagNames"))
    marked = joined.join(item_indicators(items, terms), "poemId", "left").withColumn(
        "indicators", F.coalesce("indicators", F.array().cast("array<int>"))
    )
    return flag_favourite_author(join_users(marked, users), favourites).select(
        "userId", "itemId", "rating", "label", "poemStar", "indicators", "userSex", "collectAuthor"
    )


def join_items(samples: DataFrame, items: DataFrame) -> DataFrame:
    """Samples with the features of their item; rows with any null are dropped.

    Gives the rows a full outer join followed by a null drop would give.
    """
    features = items.drop("poemDynasty").withColumns({
        "poemId": F.col("poemId").try_cast("int"),
        "poemStar": F.col("poemStar").try_cast("double"),
    })
    return samples.join(features, samples["itemId"] == features["poemId"]).dropna("any")


def lookup(table: DataFrame, key: str) -> DataFrame:
    """``table`` with one row for each ``key``: of several the smallest, column by column."""
    rest = [c for c in table.columns if c != key]
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(
        key, *(F.col("_row").getField(c).alias(c) for c in rest)
    )


def join_users(df: DataFrame, users: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``userSex``; of a user who is not in ``users`` the row goes, or with ``left`` the sex is null."""
    typed = users.select(F.col("userId").try_cast("bigint").alias("userId"), "userSex")
    return df.join(lookup(typed, "userId"), "userId", how)


def flag_favourite_author(
    df: DataFrame, favourites: DataFrame, author: str = "poemAuthorId", offset: int = AUTHOR_OFFSET
) -> DataFrame:
    """Add ``collectAuthor``: 1 when the item's author is a favourite of the user.

    The distinct favourites are written first, so that rows of a very active
    user can be split in the join.
    """
    pairs = favourites.select(
        F.col("userId").try_cast("bigint").alias("userId"),
        (F.col("authorId") + offset).cast("bigint").alias("_author"),
    ).distinct()
    marks = settle(pairs, "favourites").withColumn("collectAuthor", F.lit(1))
    keyed = df.withColumn("_author", F.col(author).cast("bigint"))
    return (
        keyed.join(marks, ["userId", "_author"], "left")
        .drop("_author")
        .withColumn("collectAuthor", F.coalesce("collectAuthor", F.lit(0)))
    )


def training_set(
    log: DataFrame, items: DataFrame, users: DataFrame, favourites: DataFrame, keep_ids: bool = False
) -> DataFrame:
    """Training rows of the ranker: rating, label, star, indicators, sex, favourite flag.

    ``items`` is the wide table of ``one_hot_table``. ``rating`` decides
    ``label``, so it is there for inspection and is no feature.
    """
    fixed = ("poemId", "poemAuthorId", "poemStar", "poemDynasty")
    indicators = [c for c in items.columns if c not in fixed]
    joined = flag_favourite_author(join_users(join_items(log, items), users), favourites)
    ids = ["userId", "itemId"] if keep_ids else []
    return joined.select(
        *ids, "rating", "label", "poemStar",
        *[F.col(f"`{c}`").try_cast("bigint").alias(c) for c in indicators],
        "userSex", "collectAuthor",
    )


def ranker_rows(
    pairs: DataFrame, items: DataFrame, users: DataFrame, favourites: DataFrame, serving: bool = False
) -> DataFrame:
    """Feature columns of (userId, itemId, ...) rows, for training and scoring.

    ``items`` is the attribute table, and its rows and those of ``users`` are made
    unique on their keys. For training, an item without author or star and a
    user without a row in ``users`` drop out. For serving every pair stays: an
    unknown author is nobody's favourite, an unknown star is 0, and an unknown
    sex is none of the known ones.
    """
    attributes = items.select(
        F.col("poemId").cast("bigint").alias("_item"), "poemAuthorId",
        F.col("poemStar").cast("double").alias("poemStar"), "poemDynasty", "poemTagNames",
    )
    if serving:
        attributes = lookup(attributes, "_item")
    else:
        attributes = lookup(attributes.dropna("any", subset=["poemAuthorId", "poemStar"]), "_item")
    how = "left" if serving else "inner"
    joined = pairs.join(attributes, F.col("itemId").cast("bigint") == F.col("_item"), how).drop("_item")
    if serving:
        joined = joined.fillna(0.0, subset=["poemStar"])
    return flag_favourite_author(join_users(joined, users, how), favourites)
