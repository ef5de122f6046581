"""Historical schedules over the filled wide ledger: working capital, roll-forwards, interest, tax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import ABS_FLOOR, MONEY, close
from .ledger import PREFIX, col_of, stacked, with_prior

PARTIAL_TAX_REASON = "only the face of the income statement is read; footnote components are not"
UNAVAILABLE = (
    ("leases", "no lease schedule can be built from face statements"),
    ("share_count", "no share count line exists on the face statements"),
)
KEYS = ("company_id",)


def present_sum(columns: Sequence[str]) -> str:
    """Sum of the present columns, NULL when none is."""
    total = " + ".join(f"coalesce({c}, CAST(0 AS {MONEY}))" for c in columns)
    return f"CASE WHEN coalesce({', '.join(columns)}) IS NOT NULL THEN CAST({total} AS {MONEY}) END"


def absent_names(columns: dict[str, str]) -> str:
    """Labels of the columns that are NULL, in the order given."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for n, c in columns.items()) + "))"


def working_capital(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Operating totals, NWC and its change per period, with the absent lines named."""
    assets = {a: col_of("balance", a) for a in dims.OPERATING_CURRENT_ASSETS}
    liabs = {a: col_of("balance", a) for a in dims.OPERATING_CURRENT_LIABILITIES}
    d = wide.selectExpr(
        *keys,
        "year",
        "cf_change_in_nwc AS reported_change",
        f"{present_sum(list(assets.values()))} AS operating_assets",
        f"{present_sum(list(liabs.values()))} AS operating_liabilities",
        f"{absent_names(assets | liabs)} AS absent",
    ).withColumn("nwc", (F.col("operating_assets") - F.col("operating_liabilities")).cast(MONEY))
    return with_prior(d, ["nwc"], keys).selectExpr(
        *keys, "year", "n", "operating_assets", "operating_liabilities", "nwc", "absent",
        f"CAST(nwc - prev_nwc AS {MONEY}) AS change_in_nwc", "reported_change",
    )


def nwc_reconcile(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Negative of the balance-sheet change against the cash-flow line, from the second period on."""
    return (
        working_capital(wide, keys)
        .where("n > 1")
        .selectExpr(*keys, "year", "'working_capital' AS schedule", f"CAST(-change_in_nwc AS {MONEY}) AS computed",
                    "reported_change AS reported", f"CAST(-change_in_nwc - reported_change AS {MONEY}) AS unexplained", "absent")
    )


DAYS = (
    ("dso", "bs_accounts_receivable", "is_revenue"),
    ("inventory_days", "bs_inventory", "is_cogs"),
    ("dpo", "bs_accounts_payable", "is_cogs"),
)


def days_drivers(wide: DataFrame, keys: Sequence[str] = KEYS, days_in_year: int = 365) -> DataFrame:
    """Year-end balance over full-year flow in days, one HALF_EVEN decimal, with a reason if undefined."""
    rows = [(f"'{n}'", b, f) for n, b, f in DAYS]
    return wide.selectExpr(*keys, "year", stacked(rows, ("driver", "balance", "flow"))).selectExpr(
        *keys,
        "year",
        "driver",
        f"bround(CAST(try_divide(balance, flow) * {days_in_year} AS DECIMAL(20,8)), 1) AS days",
        "CASE WHEN balance IS NULL THEN 'balance not reported' WHEN flow IS NULL THEN 'flow not reported'"
        " WHEN flow = 0 THEN 'flow is zero' END AS reason",
    )


def rollforward(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Opening plus disclosed movements against the reported ending; the difference is never applied."""
    part = f"OVER (PARTITION BY {', '.join(keys)})"
    d = with_prior(wide, [col_of("balance", acc) for _, acc, _ in dims.ROLLFORWARDS], keys).selectExpr(
        "*", f"max(cf_depreciation IS NOT NULL) {part} AS splits"
    )
    rows = []
    for name, acc, movements in dims.ROLLFORWARDS:
        cols, labels = [], []
        for st, a, mult, label in movements:
            c = PREFIX[st] + a
            if name == "ppe" and a == "depreciation_amortization":
                st2, a2, _, label2 = dims.SPLIT_DEPRECIATION
                c = f"CASE WHEN splits THEN {PREFIX[st2] + a2} ELSE {c} END"
                label = f"CASE WHEN splits THEN '{label2}' ELSE '{label}' END"
            else:
                label = f"'{label}'"
            cols.append((c, mult))
            labels.append(f"CASE WHEN ({c}) IS NULL THEN {label} END")
        moved = " + ".join(f"coalesce({m} * ({c}), CAST(0 AS {MONEY}))" for c, m in cols)
        opening = f"prev_{col_of('balance', acc)}"
        rows.append((f"'{name}'", opening, f"CAST({moved} AS {MONEY})", col_of("balance", acc), f"array_compact(array({', '.join(labels)}))"))
    return (
        d.where("n > 1")
        .selectExpr(*keys, "year", stacked(rows, ("schedule", "opening", "movements", "reported_ending", "absent")))
        .selectExpr(
            *keys, "year", "schedule", "opening", "movements", "reported_ending", "absent",
            f"CAST(opening + movements AS {MONEY}) AS computed_ending",
            f"CAST(opening + movements - reported_ending AS {MONEY}) AS unexplained",
        )
    )


def availability(roll: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AVAILABLE, PARTIAL or UNAVAILABLE per schedule with the reason."""
    return (
        roll.groupBy(*keys, "schedule")
        .agg(
            F.count("*").alias("periods"),
            F.count_if(F.col("computed_ending").isNull()).alias("no_opening"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("absent")))).alias("absent"),
        )
        .selectExpr(
            *keys,
            "schedule",
            "CASE WHEN no_opening = periods THEN 'UNAVAILABLE' WHEN no_opening > 0 OR size(absent) > 0 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability",
            "CASE WHEN no_opening = periods THEN 'no period has an opening balance'"
            " WHEN no_opening > 0 OR size(absent) > 0 THEN concat_ws('; ', CASE WHEN size(absent) > 0 THEN concat('not reported: ', array_join(absent, ', ')) END,"
            " CASE WHEN no_opening > 0 THEN concat('periods without opening: ', no_opening) END) ELSE '' END AS reason",
        )
    )


def total_unexplained(roll: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of a schedule's differences, NULL when any period could not be reconciled."""
    return roll.groupBy(*keys, "schedule").agg(
        F.expr(f"CASE WHEN count_if(unexplained IS NULL) = 0 THEN CAST(sum(unexplained) AS {MONEY}) END").alias("total_unexplained")
    )


def implied_interest(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Interest expense over opening and over average debt, with the reason a rate is missing."""
    d = with_prior(wide, ["bs_debt"], keys).where("n > 1").selectExpr(
        *keys, "year", "is_interest_expense AS expense", "prev_bs_debt AS opening", f"CAST((prev_bs_debt + bs_debt) / 2 AS {MONEY}) AS average"
    )
    rows = [("'beginning'", "opening"), ("'average'", "average")]
    return d.selectExpr(*keys, "year", "expense", stacked(rows, ("basis", "debt"))).selectExpr(
        *keys, "year", "basis", "expense", "debt", "CAST(try_divide(expense, debt) AS DECIMAL(20,8)) AS rate",
        "CASE WHEN expense IS NULL THEN 'no interest expense reported' WHEN debt IS NULL THEN concat(basis, ' debt not reported')"
        " WHEN debt = 0 THEN concat(basis, ' debt is zero') END AS reason",
    )


def effective_tax(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tax over pretax income; usable only inside [0, 1) on a positive base."""
    return wide.selectExpr(
        *keys, "year", "is_pretax_income AS pretax", "is_taxes AS tax", "CAST(try_divide(is_taxes, is_pretax_income) AS DECIMAL(20,8)) AS rate"
    ).selectExpr(
        "*",
        "CASE WHEN pretax IS NULL OR tax IS NULL THEN concat('not reported: ', concat_ws(' and ', CASE WHEN pretax IS NULL THEN 'pretax income' END, CASE WHEN tax IS NULL THEN 'tax expense' END))"
        " WHEN pretax = 0 THEN 'pretax income is zero' WHEN pretax < 0 THEN 'pretax income is negative'"
        " WHEN rate < 0 OR rate >= 1 THEN 'rate outside [0, 1)' END AS reason",
        "coalesce(rate >= 0 AND rate < 1, false) AS usable",
    )


def latest_usable_rate(tax: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return tax.where("usable").groupBy(*keys).agg(F.max_by("rate", "year").alias("rate"), F.max("year").alias("year"))


def chain_check(roll: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A period's beginning must equal the previous ending, within 1e-9 relative and 1 absolute."""
    over = f"OVER (PARTITION BY {', '.join(keys)}, schedule ORDER BY year)"
    d = roll.selectExpr("*", f"lag(reported_ending) {over} AS previous_ending").where("previous_ending IS NOT NULL AND opening IS NOT NULL")
    return d.withColumn("agrees", close(F.col("opening"), F.col("previous_ending"), floor="1"))


def propose_drivers(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drivers the schedules can measure, each proposed as a Draft.

    Days use the last period; the interest and depreciation rates use the first measurable one;
    tax uses the last usable rate.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    days = days_drivers(wide.selectExpr("*", f"max(year) {over} AS last_year").where("year = last_year"), keys)
    days = days.where("days IS NOT NULL").selectExpr(*keys, "driver AS code", "CAST(days AS DECIMAL(20,8)) AS value", "year AS measured_year", "'days' AS unit")
    interest = (
        implied_interest(wide, keys).where("basis = 'beginning' AND rate IS NOT NULL").groupBy(*keys)
        .agg(F.min_by("rate", "year").alias("value"), F.min("year").alias("measured_year"))
        .selectExpr(*keys, "'interest_rate_on_debt' AS code", "value", "measured_year", "'ratio' AS unit")
    )
    tax = latest_usable_rate(effective_tax(wide, keys), keys).selectExpr(*keys, "'tax_rate' AS code", "rate AS value", "year AS measured_year", "'ratio' AS unit")
    dep = with_prior(wide, ["bs_ppe_net"], keys).selectExpr("*", f"max(cf_depreciation IS NOT NULL) {over} AS splits").selectExpr(
        *keys, "year", "CAST(try_divide(CASE WHEN splits THEN cf_depreciation ELSE cf_depreciation_amortization END, prev_bs_ppe_net) AS DECIMAL(20,8)) AS rate"
    )
    dep = (
        dep.where("rate IS NOT NULL").groupBy(*keys).agg(F.min_by("rate", "year").alias("value"), F.min("year").alias("measured_year"))
        .selectExpr(*keys, "'depreciation_pct_beginning_ppe' AS code", "value", "measured_year", "'ratio' AS unit")
    )
    return days.unionByName(interest).unionByName(tax).unionByName(dep).withColumn("status", F.lit("Draft"))


NOT_MEASURABLE = (
    ("revenue_growth", "past growth is no evidence of future growth"),
    ("cogs_pct_revenue|cogs_amount", "whether cost stays a share of revenue is a decision"),
    ("opex_pct_revenue|opex_amount", "whether cost stays a share of revenue is a decision"),
    ("capex_pct_revenue|capex_amount", "investment policy is a decision"),
    ("other_current_assets_pct_revenue", "no other current assets reported"),
    ("other_current_liabilities_pct_revenue", "no other current liabilities reported"),
)


def unproposable(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Required drivers no schedule measures, with the reason; the last two only where the line is absent."""
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    last = wide.selectExpr("*", f"max(year) {over} AS last_year").where("year = last_year")
    keep = {"other_current_assets_pct_revenue": "bs_other_current_assets IS NULL", "other_current_liabilities_pct_revenue": "bs_other_current_liabilities IS NULL"}
    rows = [(f"'{c}'", f"'{r}'", keep.get(c, "true")) for c, r in NOT_MEASURABLE]
    return last.selectExpr(*keys, stacked(rows, ("code", "reason", "applies"))).where("applies").drop("applies")


def schedule_set(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All schedules in one long table: schedule, year, line, value."""
    wc = working_capital(wide, keys)
    wc_rows = [(f"'{c}'", c) for c in ("operating_assets", "operating_liabilities", "nwc", "change_in_nwc")]
    out = wc.selectExpr(*keys, "year", "'working_capital' AS schedule", stacked(wc_rows, ("line", "value")))
    roll_rows = [(f"'{c}'", c) for c in ("opening", "movements", "computed_ending", "reported_ending", "unexplained")]
    roll = rollforward(wide, keys).selectExpr(*keys, "year", "schedule", stacked(roll_rows, ("line", "value")))
    days = days_drivers(wide, keys).selectExpr(*keys, "year", "'days' AS schedule", "driver AS line", f"CAST(days AS {MONEY}) AS value")
    tax = effective_tax(wide, keys).selectExpr(*keys, "year", "'tax' AS schedule", "'effective_rate' AS line", f"CAST(rate AS {MONEY}) AS value")
    interest = implied_interest(wide, keys).selectExpr(*keys, "year", "'interest' AS schedule", "basis AS line", f"CAST(rate AS {MONEY}) AS value")
    return out.unionByName(roll).unionByName(days).unionByName(tax).unionByName(interest)


def reconcile(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One check row per schedule: exact ties and ties within tolerance are counted apart."""
    ok = close(F.col("computed"), F.col("reported"))
    return (
        rows.withColumns({"comparable": F.col("computed").isNotNull() & F.col("reported").isNotNull(), "ok": ok})
        .groupBy(*keys, "schedule")
        .agg(
            F.count_if("comparable").alias("checked"),
            F.count_if(F.col("comparable") & ~F.col("ok")).alias("failed"),
            F.count_if(F.col("comparable") & (F.col("computed") == F.col("reported"))).alias("exact"),
        )
        .selectExpr(
            *keys, "schedule", "checked", "failed", "exact", "checked - failed - exact AS within_tolerance",
            "CASE WHEN checked = 0 THEN 'SKIP' WHEN failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status",
        )
    )


def reconciliations(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    roll = rollforward(wide, keys).selectExpr(*keys, "year", "schedule", "computed_ending AS computed", "reported_ending AS reported")
    return roll.unionByName(nwc_reconcile(wide, keys).selectExpr(*keys, "year", "schedule", "computed", "reported"))


FORECAST_INTEREST_BASIS = "beginning"  # what the forecast charges interest on


def interest_basis_check(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the history states interest on the basis that the forecast charges it on."""
    i = implied_interest(wide, keys)
    g = i.groupBy(*keys).agg(F.count_if(F.col("basis") == FORECAST_INTEREST_BASIS).alias("stated"), F.count_if((F.col("basis") == FORECAST_INTEREST_BASIS) & F.col("rate").isNotNull()).alias("computed"))
    return g.selectExpr(
        *keys, "'interest basis matches the forecast' AS check_name", "CASE WHEN stated = 0 THEN 'FAIL' WHEN computed = 0 THEN 'SKIP' ELSE 'PASS' END AS status",
        f"CASE WHEN stated = 0 THEN 'the {FORECAST_INTEREST_BASIS} basis is not stated' WHEN computed = 0 THEN 'no rate could be computed' ELSE concat(computed, ' periods on {FORECAST_INTEREST_BASIS} debt') END AS detail",
    )


def explained_check(roll: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every schedule that is not available says why (C14)."""
    a = availability(roll, keys).groupBy(*keys).agg(F.count_if(F.col("availability") == "UNAVAILABLE").alias("gone"), F.count_if((F.col("availability") != "AVAILABLE") & (F.col("reason") == "")).alias("silent"))
    return a.selectExpr(*keys, "'schedules are available or explained' AS check_name", "CASE WHEN silent > 0 THEN 'FAIL' ELSE 'PASS' END AS status", "concat(gone, ' unavailable, ', silent, ' without a reason') AS detail")


def schedule_checks(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole set: every reconciliation, the interest basis, and gaps explained."""
    ties = reconcile(reconciliations(wide, keys), keys).selectExpr(*keys, "concat(schedule, ' reconciles') AS check_name", "status", "concat(checked, ' periods, ', failed, ' out') AS detail")
    return ties.unionByName(interest_basis_check(wide, keys)).unionByName(explained_check(rollforward(wide, keys), keys))
