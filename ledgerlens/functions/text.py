"""Text, id and vocabulary expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payment status spellings and what they become in the batch tables.
BATCH_STATUS = {
    "payment in-progress": "payment_in_progress",
    "in progress": "in_progress",
    "payment completed": "payment_completed",
}
# Spellings that only the event stream translates.
STREAM_STATUS = {
    "payment success": "successful",
    "payment in-progress": "payment_in_progress",
}
# Delay-model category codes.
CATEGORY_CODES = {
    "Normal/Others": 0,
    "Repair and Renovation": 1,
    "Trust and Society": 2,
    "Bar and Associations": 3,
}
# Words that mark a concrete place in a work description.
LOCATION_MARKERS = (
    r"(ward|gp |gram panchayat|sector|nagar|village|phase|plot|block|mohalla|tola|pada|khurd|kalan|chowk|marg|road no)"
)


def lookup(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Literal map lookup; keys that are absent give ``default`` (null when not given)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def canonical_header(name: str) -> str:
    """``'Recommended Amount (₹)'`` -> ``'recommended amount'``; plain Python because headers are driver metadata."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def normalize_description(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def project_key(*parts: Column) -> Column:
    """``work_id|mp|constituency|state`` with blanks for nulls."""
    return F.concat_ws("|", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])


def key_part(c: Column, index: int) -> Column:
    """Part ``index`` (1-based) of a composite key; the MP part needs all four parts."""
    part = F.trim(F.split_part(c, F.lit("|"), F.lit(index)))
    if index == 1:
        return part
    return F.when(F.size(F.split(c, r"\|")) >= 4, part).otherwise(F.lit(""))


def batch_payment_status(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case and translate; pass ``STREAM_STATUS`` as ``aliases`` to share the stream vocabulary."""
    low = F.lower(F.trim(c))
    return lookup(low, {**BATCH_STATUS, **(aliases or {})}, low)


def stream_payment_status(c: Column) -> Column:
    """Canonical status for events: null stays null, blank becomes null."""
    raw = F.trim(c)
    return F.when(raw != "", lookup(F.lower(raw), STREAM_STATUS, F.lower(raw)))


def has_location_marker(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(LOCATION_MARKERS), F.lit(False))


def hash_identity(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), F.trim(c)), 256)


def mask_identity(hashed: Column) -> Column:
    return F.concat(F.lit("CIT-XXXX XXXX "), F.right(hashed, F.lit(4)))


def fingerprint(columns: dict[str, Column]) -> Column:
    """First 20 hex digits of the SHA-256 of the row as JSON with its keys in order."""
    text = [F.coalesce(F.trim(columns[k].cast("string")), F.lit("")).alias(k) for k in sorted(columns)]
    return F.substring(F.sha2(F.to_json(F.struct(*text)), 256), 1, 20)


def event_id(prefix: str, project_id: Column, event_type: Column, source_id: Column) -> Column:
    safe = F.translate(F.translate(project_id, "|", "-"), " ", "_")
    return F.concat_ws("-", F.lit(prefix), safe, F.lower(event_type), source_id)


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive literal substring; null never matches."""
    return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(needle.lower())), F.lit(False))


def category_code(c: Column) -> Column:
    return lookup(c, CATEGORY_CODES, F.lit(0))
