"""Fixed-point types and the arithmetic rules every operator shares.

A product of MONEY and RATE fits 38 digits exactly, so each flow is rounded once, on the cast
back to MONEY, and sums of such flows are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(25,8)"
RATE = "decimal(12,8)"
FACTOR = "decimal(22,18)"
INTEGER_DIGITS, DECIMAL_DIGITS = 17, 8  # of MONEY

# Default tolerances of the checks.
REL_TOLERANCE = "0.000000001"
SUBTOTAL_REL_TOLERANCE = "0.000001"
ABS_FLOOR = "0"  # a floor is the caller's choice: in statements kept in millions it would hide differences


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def rate(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(RATE)


def lit_money(v: str) -> Column:
    return F.lit(v).cast(MONEY)


def to_decimal(c: Column, kind: str = MONEY) -> Column:
    """Text to decimal; anything that is not a finite number becomes NULL, never an error."""
    return F.trim(c).try_cast(kind)


def times(amount: Column, factor: Column) -> Column:
    """MONEY x RATE, rounded once."""
    return (amount * factor).cast(MONEY)


def ratio(num: Column, den: Column, kind: str = "decimal(20,8)") -> Column:
    """num / den, NULL when the base is absent or zero."""
    return F.try_divide(num, den).cast(kind)


def close(a: Column, b: Column, rel: str = REL_TOLERANCE, floor: str = ABS_FLOOR) -> Column:
    """abs(a-b) within max(rel * larger magnitude, floor)."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= F.greatest(larger * F.lit(rel).cast("decimal(10,9)"), F.lit(floor).cast("decimal(10,9)"))


def relative_error_pct(actual: Column, expected: Column) -> Column:
    """Percent error; undefined against zero."""
    return (F.try_divide(F.abs(actual - expected), F.abs(expected)) * 100).cast("decimal(20,8)")


def int_power(base: Column, n: Column) -> Column:
    """base ** n for whole n >= 0 as repeated multiplication at factor scale."""
    b = base.cast("decimal(16,14)")
    steps = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit("1").cast(FACTOR), lambda acc, _: (acc * b).cast(FACTOR))


# Display places per unit.
DISPLAY_PLACES = {"currency": 0, "percent": 1, "ratio": 4, "days": 1, "integer": 0, "factor": 6}


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def display(c: Column, places: int) -> Column:
    """Printed form: HALF_EVEN, thousands separators, a dash for an absent value."""
    return F.coalesce(F.format_number(F.bround(c, places), places), F.lit("—"))


def is_rounded(c: Column, places: int) -> Column:
    return c.isNotNull() & (F.bround(c, places) != c)


def tooltip(c: Column, places: int) -> Column:
    """Full value text where the display loses information."""
    return F.when(is_rounded(c, places), c.cast("string"))


def unit_multiplier(units: Column) -> Column:
    return (
        F.when(units == "dollars", F.lit(1))
        .when(units == "thousands", F.lit(1000))
        .when(units == "millions", F.lit(1000000))
    )


def survives_double(c: Column) -> Column:
    """True when the decimal comes back unchanged from a 16-significant-digit double."""
    return F.format_string("%.16g", c.cast("double")).cast("double").cast(MONEY) == c.cast(MONEY)


def exact_decimal(text: Column) -> tuple[Column, Column]:
    """(value, problem): text read as an amount without rounding it. A figure that MONEY cannot hold as printed is a problem, not a nearby figure."""
    t = F.trim(text)
    wide = t.try_cast("decimal(38,12)")
    value = t.try_cast(MONEY)
    problem = (
        F.when(t.isNull() | (t == ""), "absent").when(~t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "not a decimal")
        .when(t.rlike(r"\.\d{12}\d*[1-9]") | (wide.isNotNull() & value.isNotNull() & (wide != value)), "more decimals than are kept").when(value.isNull(), "out of range")
    )
    return F.when(problem.isNull(), value), problem
