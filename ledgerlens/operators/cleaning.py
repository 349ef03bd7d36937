"""Raw text tables to typed, deduplicated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_bool, parse_date
from ledgerlens.functions.numbers import parse_amount
from ledgerlens.functions.text import STREAM_STATUS, batch_payment_status, normalize_text
from ledgerlens.schemas import AMOUNT_COLUMNS, BOOL_COLUMNS, DATE_COLUMNS, RAW_COLUMNS


def clean_table(raw: DataFrame, table: str, shared_status: bool = True, day_first: bool = False) -> DataFrame:
    """Type every known column of a raw table, then drop rows that repeat exactly.

    ``shared_status`` also translates the spellings of the event stream (``payment success``); ``day_first`` is how the
    source writes dates that can be read both ways.
    """
    aliases = STREAM_STATUS if shared_status else None
    known = set(RAW_COLUMNS[table].values())
    out = []
    for name in raw.columns:
        c = F.col(name)
        if name not in known:
            out.append(c)
        elif name in AMOUNT_COLUMNS:
            out.append(parse_amount(c).alias(name))
        elif name in DATE_COLUMNS:
            out.append(parse_date(c, day_first).alias(name))
        elif name in BOOL_COLUMNS:
            out.append(parse_bool(c).alias(name))
        elif name == "payment_status":
            out.append(batch_payment_status(normalize_text(c), aliases).alias(name))
        else:
            out.append(normalize_text(c).alias(name))
    if table == "expenditures":
        out.append(F.lit("unmatched").alias("match_status"))
    return raw.select(*out).dropDuplicates()
