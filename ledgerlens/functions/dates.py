"""Tolerant and strict date parsing; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, tried in this order.
STRICT_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyyMMdd"]
ISO_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]
MONTH_FIRST = ["MM/dd/yyyy", "MM-dd-yyyy"]
DAY_FIRST = ["dd/MM/yyyy", "dd-MM-yyyy"]
TEXTUAL_FORMATS = ["d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"]


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Timestamp or null; the usual words for a missing value are null.

    ISO forms come first, then numbers with slashes or dashes, then textual months in any case. Where both readings of a
    numeric date are possible, the month comes first, or the day with ``day_first``; where only one is, that one counts.
    """
    text = F.trim(c.cast("string"))
    text = F.when(~F.lower(text).isin("", "nan", "na", "n/a", "none"), text)
    numeric = [*DAY_FIRST, *MONTH_FIRST] if day_first else [*MONTH_FIRST, *DAY_FIRST]
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in [*ISO_FORMATS, *numeric]]
    named = [F.try_to_timestamp(F.initcap(F.lower(text)), F.lit(f)) for f in TEXTUAL_FORMATS]
    return F.coalesce(text.try_cast("timestamp"), *parsed, *named)


def strict_date(c: Column) -> Column:
    """Date part before ``T`` or a blank, in one of five formats."""
    text = F.split_part(F.split_part(F.trim(c.cast("string")), F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in STRICT_FORMATS])


def parse_bool(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isNull(), F.lit(False))
        .when(text.isin("1", "true", "yes", "y"), F.lit(True))
        .when(text.isin("0", "false", "no", "n"), F.lit(False))
        .otherwise(text != "")
    )


def iso_utc(c: Column) -> Column:
    """Any timestamp as ``yyyy-MM-ddTHH:mm:ssZ``; text without an offset is UTC (session zone must be UTC)."""
    return F.date_format(c.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")
