"""Numeric parsing, guarded arithmetic, rounding and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity scores.
SEVERITY_SCORE = {"LOW": 20, "MEDIUM": 40, "HIGH": 70, "CRITICAL": 90}


def rounded(c: Column, digits: int) -> Column:
    """Half-even rounding by scaling, the array-library convention the published scores use."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def finite(c: Column, default: float | None = None) -> Column:
    """Double with NaN and infinities as null, or ``default`` for every missing value."""
    value = c.try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)  # NaN sorts above infinity
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value that is not null; null would become ``high``."""
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def clip_or_null(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), clip(c, low, high))


def sigmoid(c: Column, slope: float, centre: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-slope) * (c - F.lit(centre))))


def ladder(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """First step whose bound is ``<= c`` wins; write the steps from the highest bound down."""
    out = reduce(lambda acc, s: acc.when(c >= s[0], F.lit(s[1])), steps[1:], F.when(c >= steps[0][0], F.lit(steps[0][1])))
    return out.otherwise(F.lit(otherwise))


def parse_amount(c: Column) -> Column:
    """Money text to double: marks, commas and blanks go, ``(x)`` is negative, else the first number in the text."""
    text = F.regexp_replace(F.trim(c.cast("string")), "₹|Rs|INR|,| ", "")
    text = F.replace(F.replace(text, F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    first = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    return finite(F.coalesce(text.try_cast("double"), F.nullif(first, F.lit("")).try_cast("double")))


def safe_float(c: Column, default: float | None = None) -> Column:
    value = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def safe_int(c: Column, default: int | None = None) -> Column:
    value = safe_float(c).cast("long")
    return value if default is None else F.coalesce(value, F.lit(default).cast("long"))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(safe_float(num), safe_float(den)), F.lit(float(default)))


def threshold(c: Column, op: str, limit: float) -> Column:
    """Comparison by name; null and unknown operators are false."""
    tests = {
        ("gt", ">"): lambda: c > limit,
        ("gte", "ge", ">="): lambda: c >= limit,
        ("lt", "<"): lambda: c < limit,
        ("lte", "le", "<="): lambda: c <= limit,
        ("eq", "=="): lambda: c == limit,
        ("ne", "!="): lambda: c != limit,
    }
    for names, test in tests.items():
        if op.lower().strip() in names:
            return F.coalesce(test(), F.lit(False))
    return F.lit(False)


def severity_score(severity: Column, triggered: Column) -> Column:
    pairs = [F.lit(x) for kv in SEVERITY_SCORE.items() for x in kv]
    score = F.coalesce(F.element_at(F.create_map(*pairs), F.upper(severity)), F.lit(20))
    return F.when(triggered, score).otherwise(F.lit(0)).cast("long")


def display_score(c: Column) -> Column:
    """0..1 score as a 0..100 integer, half-even."""
    return F.rint(c * 100).cast("long")


def plain(c: Column) -> Column:
    """Shortest decimal text of a double (``5.0`` not ``5``)."""
    return c.cast("double").cast("string")


def money(c: Column, digits: int = 2) -> Column:
    return F.format_number(c, digits)


def format_inr(c: Column) -> Column:
    return (
        F.when(c.isNull() | F.isnan(c), F.lit("N/A"))
        .when(c >= 1e7, F.concat(F.lit("₹"), fixed(c / 1e7, 2), F.lit(" Cr")))
        .when(c >= 1e5, F.concat(F.lit("₹"), fixed(c / 1e5, 2), F.lit(" Lakh")))
        .otherwise(F.concat(F.lit("₹"), F.format_number(c, 0)))
    )


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def tags(options: list[Column], none: str | None = None, sep: str = "|") -> Column:
    """Join the non-null options in order; ``none`` when there are none."""
    kept = F.array_compact(F.array(*options))
    text = F.array_join(kept, sep)
    return text if none is None else F.when(F.size(kept) > 0, text).otherwise(F.lit(none))


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half-even like the scores."""
    return F.format_string(f"%.{digits}f", rounded(c, digits))
