"""The period axis of each company: the years it reports, the years it is forecast for, and what is wrong with them.

An axis is either a stated list of years, the same for all companies, or a number of years right after each company's own
last actual one. Every period-over-period figure assumes that neighbouring years are one year apart, so a gap, a repeat or a
forecast that does not start right behind the last actual year refuses the company by name instead of skipping years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

Axis = Sequence[int] | int


def years_array(years: Sequence[int]) -> str:
    return f"CAST(array({', '.join(map(str, years))}) AS ARRAY<INT>)"


def forecast_years(axis: Axis, last: str = "last_actual") -> str:
    """SQL of the forecast years; NULL where there is no actual year to start from."""
    if isinstance(axis, int):
        return f"CASE WHEN {last} IS NOT NULL THEN CAST(sequence({last} + 1, {last} + {axis}) AS ARRAY<INT>) END"
    return years_array(axis)


def problem(actual: str = "actual_years", axis: str = "forecast_years") -> str:
    """SQL of what is wrong with sorted actual years and forecast years in their stated order, or NULL."""
    jumps = lambda a, wrong: f"array_join(transform({a}, (x, i) -> CASE WHEN i > 0 AND {wrong.format('element_at(' + a + ', i)')} THEN concat(element_at({a}, i), ' -> ', x) END), ', ')"
    found = [
        (f"{axis} IS NULL OR size({axis}) = 0", "'no forecast year'"),
        (f"size(array_distinct({actual})) < size({actual})", "'historical years are repeated'"),
        (f"{jumps(actual, 'x <> {0} + 1')} <> ''", f"concat('historical years are not consecutive: ', {jumps(actual, 'x <> {0} + 1')})"),
        (f"{jumps(axis, 'x <= {0}')} <> ''", "'forecast years are not in ascending order'"),
        (f"{jumps(axis, 'x <> {0} + 1')} <> ''", f"concat('forecast years are not consecutive: ', {jumps(axis, 'x <> {0} + 1')})"),
        (f"element_at({axis}, 1) <> element_at({actual}, -1) + 1", f"concat('first forecast year ', element_at({axis}, 1), ' does not follow the last actual ', element_at({actual}, -1))"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in found) + " END"


def company_axis(wide: DataFrame, axis: Axis) -> DataFrame:
    """company_id, actual_years, last_actual, forecast_years, period_problem of every company with an actual year."""
    years = wide.groupBy("company_id").agg(F.sort_array(F.collect_list("year")).alias("actual_years"))
    d = years.selectExpr("*", "element_at(actual_years, -1) AS last_actual")
    return d.selectExpr("*", f"{forecast_years(axis)} AS forecast_years").selectExpr("*", f"{problem()} AS period_problem")
