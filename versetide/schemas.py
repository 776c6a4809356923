"""Schemas of the relations that are read from outside."""

from pyspark.sql import types as T

ACCESS_LOG = T.StructType([
    T.StructField("logId", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("accessIP", T.StringType()),
    T.StructField("executionTime", T.LongType()),
    T.StructField("visitTime", T.TimestampType()),
    T.StructField("url", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("userId", T.StringType()),
])

USER_LOG = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("itemId", T.IntegerType()),
    T.StructField("rating", T.LongType()),
    T.StructField("label", T.IntegerType()),
])

USER_INFO = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("userSex", T.StringType()),
])

FAVOURITES = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("authorId", T.LongType()),
])

ITEM_ATTRIBUTES = T.StructType([
    T.StructField("poemId", T.IntegerType()),
    T.StructField("poemAuthorId", T.IntegerType()),
    T.StructField("poemStar", T.DoubleType()),
    T.StructField("poemDynasty", T.StringType()),
    T.StructField("poemTagNames", T.StringType()),
])

SIMILAR_ITEMS = T.StructType([
    T.StructField("poemId", T.LongType()),
    T.StructField("top100", T.ArrayType(T.LongType())),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
])

IMPRESSIONS = T.StructType([
    T.StructField("impressionId", T.StringType()),
    T.StructField("userId", T.LongType()),
    T.StructField("items", T.ArrayType(T.IntegerType())),
])

RECENT_ACTIVITY = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("recent", T.ArrayType(T.StringType())),
])

EVENT_ENVELOPE = T.ArrayType(T.StructType([
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
]))
