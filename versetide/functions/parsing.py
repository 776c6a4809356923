"""Column expressions that read the access log and the event headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log format.
SEARCH_PREFIX = "search"
ITEM_METHODS = ("showPoetryDetails", "collectPoem", "evaluatePoem", "toPoemDetails")
POET_METHODS = ("collectAuthor", "showAuthorDetails")
TO_DETAILS = r"(?d)poemId=(.+)"
SHOW_DETAILS = r"(?d)d=(.*?)&"
COLLECT = r"(?d)poemId=(.*?)&collection=(.+)"
EVALUATE = r"(?d)like=(.+)&poemId=(.+)"
NO_ITEM = "NoPoemID"
HEADER_FIELDS = ("userId", "age", "name", "itemId", "click")


def extract(text: Column, pattern: str, group: int) -> Column:
    """First match of a group; null where nothing (or only '') matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def method_name(method: Column) -> Column:
    """Third piece of ``[log]service[..]name``; null with fewer pieces."""
    return F.get(F.split(method, "]"), F.lit(2))


def item_of(method: Column, parameter: Column) -> Column:
    """Item id named by a log parameter, as int.

    The show rule takes the first key that ends in ``d`` and needs a following
    ``&``. Text that is no whole number gives null (so does ``3.7``).
    """
    text = (
        F.when(method == "toPoemDetails", extract(parameter, TO_DETAILS, 1))
        .when(method == "showPoetryDetails", extract(parameter, SHOW_DETAILS, 1))
        .when(method == "collectPoem", extract(parameter, COLLECT, 1))
        .when(method == "evaluatePoem", extract(parameter, EVALUATE, 2))
    )
    return text.try_cast("int")


def rating_of(method: Column, parameter: Column, item: Column) -> Column:
    """Score of one action: views 1, collect and like +2, taken back -2."""
    flag = (
        F.when(method == "collectPoem", extract(parameter, COLLECT, 2))
        .when(method == "evaluatePoem", extract(parameter, EVALUATE, 1))
    )
    return (
        F.when(method.isin("toPoemDetails", "showPoetryDetails") & item.isNotNull(), 1)
        .when(flag == "0", -2)
        .when(flag.isNotNull(), 2)
    )


def label_of(rating: Column) -> Column:
    """1 for a positive sum, else 0; a null sum is 0."""
    return F.when(rating > 0, 1).otherwise(0)


def tag_list(tags: Column) -> Column:
    """Comma list as array; null gives an empty array."""
    return F.coalesce(F.split(tags, ","), F.array().cast("array<string>"))


def entry_item(entry: Column) -> Column:
    """Item id of an activity entry ``<id or NoPoemID>-tag-tag``."""
    head = F.get(F.split(entry, "-"), F.lit(0))
    return F.when(head != NO_ITEM, head.try_cast("int"))


def entry_tags(entry: Column) -> Column:
    """Tags of an activity entry."""
    pieces = F.split(entry, "-")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def header_field(text: Column, field: str) -> Column:
    """One field of ``{a=1, b=2}``: spaces removed, the last of repeated keys wins."""
    pattern = rf"(?s)^.*[{{,]{field}=([^,}}]*)"
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(F.regexp_like(bare, F.lit(pattern)), F.regexp_extract(bare, pattern, 1))


def digest(seed, *columns) -> Column:
    """Repeatable pseudo-random text of a key: md5 of ``seed:key:key``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def digest_number(text: Column) -> Column:
    """First 32 bits of a digest as a number."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
