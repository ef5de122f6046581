"""Derived metrics: a table of Spark SQL expressions over a wide period row.

Expressions are code and come from trusted configuration only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..money import MONEY
from .ledger import col_of, stacked

# (target, expression, inputs, unit)
Metric = tuple[str, str, Sequence[str], str]


def define(metrics: Sequence[Metric]) -> list[Metric]:
    """Refuses two metrics with one target."""
    seen = [m[0] for m in metrics]
    dup = sorted({t for t in seen if seen.count(t) > 1})
    if dup:
        raise ValueError(f"metric targets defined twice: {', '.join(dup)}")
    return list(metrics)


def order(metrics: Sequence[Metric]) -> list[Metric]:
    """Definition order in which every metric follows the metrics it reads; refuses a cycle."""
    pending, done, out = list(metrics), set(), []
    targets = {m[0] for m in metrics}
    while pending:
        ready = [m for m in pending if not ((set(m[2]) & targets) - done)]
        if not ready:
            raise ValueError("metrics form a cycle: " + ", ".join(m[0] for m in pending))
        out += ready
        done |= {m[0] for m in ready}
        pending = [m for m in pending if m[0] not in done]
    return out


def required_inputs(metrics: Sequence[Metric]) -> list[str]:
    """Inputs read minus targets computed."""
    return sorted({i for m in metrics for i in m[2]} - {m[0] for m in metrics})


def dependents(metrics: Sequence[Metric], changed: Sequence[str]) -> list[str]:
    """Everything downstream of a change."""
    hit = set(changed)
    for m in order(metrics):
        if set(m[2]) & hit:
            hit.add(m[0])
    return sorted(hit - set(changed))


def computable(metrics: Sequence[Metric], available: Sequence[str]) -> list[str]:
    """Metrics whose inputs can be reached."""
    have = set(available)
    out = []
    for m in order(metrics):
        if set(m[2]) <= have:
            have.add(m[0])
            out.append(m[0])
    return out


def evaluate(wide: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    """Long (keys, metric, value, reason): a missing input or undefined result is NULL with a reason."""
    out = wide
    ordered = order(define(metrics))
    for t, e, inputs, _ in ordered:
        known = " AND ".join(f"{i} IS NOT NULL" for i in inputs)
        out = out.selectExpr("*", f"CASE WHEN {known} THEN CAST({e} AS {MONEY}) END AS {t}")
    rows = []
    for t, _, inputs, unit in ordered:
        missing = "array_compact(array(" + ", ".join(f"CASE WHEN {i} IS NULL THEN '{i}' END" for i in inputs) + "))"
        rows.append((f"'{t}'", t, f"'{unit}'", f"CASE WHEN {t} IS NULL THEN CASE WHEN size({missing}) > 0 THEN concat('missing: ', array_join({missing}, ', ')) ELSE 'undefined' END END"))
    return out.selectExpr(*keys, stacked(rows, ("metric", "value", "unit", "reason")))


def evaluate_strict(wide: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    r = evaluate(wide, metrics, keys)
    bad = r.where("reason IS NOT NULL").select("metric", "reason").take(1)
    if bad:
        raise ValueError(f"metric {bad[0].metric}: {bad[0].reason}")
    return r


def derivation_metrics() -> list[tuple[str, str]]:
    """Subtotals as metric expressions over one period row, across statements.

    Optional terms count as nil only when a sibling is present; assumed_nil() records which."""
    first = {a: s for a, ss, *_ in reversed(dims.CHART) for s in ss[-1:]}
    return [(t, _expr(t, first)) for t in dims.DERIVATIONS]


def _expr(t: str, first: dict[str, str]) -> str:
    _, plus, minus = dims.DERIVATIONS[t]
    cols = [(col_of(first[x], x), op, x in dims.OPTIONAL_TERMS) for xs, op in ((plus, "+"), (minus, "-")) for x in xs]
    known = " AND ".join(f"{c} IS NOT NULL" for c, _, o in cols if not o) or f"coalesce({', '.join(c for c, _, _ in cols)}) IS NOT NULL"
    return f"CASE WHEN {known} THEN CAST({' '.join(f'{op} coalesce({c}, CAST(0 AS {MONEY}))' for c, op, _ in cols)} AS {MONEY}) END"


def metric_environment(wide: DataFrame, keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    """Each subtotal by its rule over all statements, with the optional terms taken as nil.

    Unlike a ledger, this reaches EBITDA, whose parts sit on two statements."""
    first = {a: s for a, ss, *_ in reversed(dims.CHART) for s in ss[-1:]}
    rows = []
    for t, (_, plus, minus) in dims.DERIVATIONS.items():
        e = _expr(t, first)
        nil = [f"CASE WHEN {col_of(first[x], x)} IS NULL THEN '{x}' END" for x in plus + minus if x in dims.OPTIONAL_TERMS] + ["CAST(NULL AS STRING)"]
        rows.append((f"'{t}'", e, f"CASE WHEN ({e}) IS NOT NULL THEN array_join(array_compact(array({', '.join(nil)})), ',') END"))
    return wide.selectExpr(*keys, stacked(rows, ("metric", "value", "assumed_nil"))).where("value IS NOT NULL")


def unit_conflicts(metrics: Sequence[Metric], units: dict[str, str]) -> list[str]:
    """Sums and differences whose operands declare different units."""
    known = units | {m[0]: m[3] for m in metrics}
    out = []
    for t, e, inputs, unit in metrics:
        if any(op in e for op in "*/("):
            continue
        if {known.get(i, unit) for i in inputs} - {unit}:
            out.append(t)
    return out


def recompute_affected(wide: DataFrame, metrics: Sequence[Metric], changed: Sequence[str], keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    """Only the metrics downstream of a change; the rest are pruned from the plan."""
    hit = set(dependents(metrics, changed))
    return evaluate(wide, metrics, keys).where(F.col("metric").isin(sorted(hit)))


def overwrite_affected(wide: DataFrame, metrics: Sequence[Metric], changed: Sequence[str] | None, path: str, keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    """Metric values kept under `path`, a partition per metric: only the partitions downstream of `changed` are computed and
    replaced (all of them for None), the others are not touched (X05). Returns the whole table."""
    rows = evaluate(wide, metrics, keys) if changed is None else recompute_affected(wide, metrics, changed, keys)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("metric").parquet(path)
    return wide.sparkSession.read.schema(rows.schema).parquet(path)
