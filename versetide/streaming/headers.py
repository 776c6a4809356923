"""Event headers; the same functions serve batch and stream frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetide.functions.parsing import HEADER_FIELDS, header_field
from versetide.schemas import EVENT_ENVELOPE


def parse_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """One row (headers, body) per event of a JSON array; other columns are kept."""
    keep = [c for c in df.columns if c != column]
    events = F.from_json(column, EVENT_ENVELOPE)
    return df.select(*keep, F.explode(events).alias("_event")).select(*keep, "_event.headers", "_event.body")


def parse_headers(df: DataFrame, column: str = "headers") -> DataFrame:
    """Replace headers by the five click fields, null where absent.

    ``column`` is a map, or the text ``{a=1, b=2}``. In the text all spaces are
    removed, and a value cannot hold a comma or a brace.
    """
    keep = [c for c in df.columns if c != column]
    if df.schema[column].dataType.typeName() == "map":
        fields = [F.try_element_at(F.col(column), F.lit(f)).alias(f) for f in HEADER_FIELDS]
    else:
        fields = [header_field(F.col(column), f).alias(f) for f in HEADER_FIELDS]
    return df.select(*keep, *fields)
