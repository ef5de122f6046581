"""The same inputs and operators as SQL text, for an independent engine to recompute."""

from __future__ import annotations

from .. import dims
from ..sources import derived as D

M = "DECIMAL(25,8)"
R = "DECIMAL(12,8)"


def q(v) -> str:
    return "NULL" if v is None else (str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'")


def values(rows, cols: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({cols})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str, head: str = "") -> None:
    CTES[name] = (deps, sql)


def sql(select: str, *needs: str, swap: dict[str, str] | None = None) -> str:
    """Assemble the named common table expressions the statement needs, in dependency order. `swap` gives
    some of them another text, whose {0} stands for the usual one."""
    order: list[str] = []
    text = {n: CTES[n][1] if n not in (swap or {}) else swap[n].replace("{0}", CTES[n][1]) for n in CTES}

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = ", ".join(f"{n}{_COLS.get(n, '')} AS ({text[n]})" for n in order)
    return (f"WITH RECURSIVE {parts} " if parts else "") + select


_COLS: dict[str, str] = {}

cte(
    "li",
    "SELECT l.l_suppkey AS company_id, CAST(year(l.l_shipdate) AS INTEGER) AS year,"
    " CAST(l.l_extendedprice AS DECIMAL(12,2)) AS px, CAST(l.l_discount AS DECIMAL(4,2)) AS disc,"
    " CAST(l.l_tax AS DECIMAL(4,2)) AS tx, CAST(l.l_quantity AS DECIMAL(8,2)) AS q,"
    " CAST(p.p_retailprice AS DECIMAL(12,2)) AS rp, l.l_returnflag AS rf, l.l_linestatus AS ls"
    " FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey",
)
cte(
    "cy",
    "SELECT company_id, year, "
    + ", ".join(f"CAST({e} AS DECIMAL(25,4)) AS {n}" for n, e in D.COMPANY_YEAR_SUMS)
    + " FROM li GROUP BY company_id, year",
    "li",
)
cte(
    "ledger",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT company_id, '{s}' AS statement, '{a}' AS account, year, CAST({e} AS {M}) AS value FROM cy"
        for s, a, e in D.LEDGER_LINES
    )
    + ") WHERE value IS NOT NULL",
    "cy",
)
_PREFIX = {"income": "is_", "balance": "bs_", "cashflow": "cf_"}
cte(
    "wide",
    "SELECT company_id, year, "
    + ", ".join(
        f"MAX(CASE WHEN statement = '{s}' AND account = '{a}' THEN value END) AS {_PREFIX[s]}{a}" for s, a in dims.slots()
    )
    + " FROM ledger GROUP BY company_id, year",
    "ledger",
)


def _derive_level(src: str, targets: list[str]) -> str:
    repl = []
    for t in targets:
        st, plus, minus = dims.DERIVATIONS[t]
        px = _PREFIX[st]
        avail = {a for s, a in dims.slots() if s == st}
        if any(x not in avail and x not in dims.OPTIONAL_TERMS for x in plus + minus):
            continue
        terms = [(x, "+") for x in plus] + [(x, "-") for x in minus]
        req = [f"{px}{x} IS NOT NULL" for x, _ in terms if x not in dims.OPTIONAL_TERMS]
        total = "0 " + " ".join(f"{s} COALESCE({px}{x}, 0)" for x, s in terms)
        anyp = " OR ".join(f"{px}{x} IS NOT NULL" for x, _ in terms)
        cond = " AND ".join(req + [f"({anyp})"])
        repl.append(f"COALESCE({px}{t}, CASE WHEN {cond} THEN CAST({total} AS {M}) END) AS {px}{t}")
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM {src}"


_prev = "wide"
for _i, _targets in enumerate(dims.levels()):
    _name = f"derived{_i + 1}" if _i + 1 < len(dims.levels()) else "derived"
    _sql = _derive_level(_prev, _targets)
    if "REPLACE ()" in _sql:
        _sql = f"SELECT * FROM {_prev}"
    cte(_name, _sql, _prev)
    _prev = _name


def unpivot(src: str, keys: str = "company_id, year") -> str:
    return (
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {keys}, '{s}' AS statement, '{a}' AS account, {_PREFIX[s]}{a} AS value FROM {src}" for s, a in dims.slots()
        )
        + ") WHERE value IS NOT NULL"
    )


cte("filled", unpivot("derived"), "derived")

cte("scenario", "SELECT s_suppkey AS company_id, v.* FROM supplier, ("
    + values([(s, p, n) for s, p, n in D.SCENARIOS], "scenario_id, parent_id, name", "v") + ") v")
cte(
    "lastact",
    "SELECT company_id, "
    + ", ".join(
        f"CAST({e} AS {M}) AS {a}"
        for s, a, e in D.LEDGER_LINES
        if s != "cashflow" and a in ("revenue", "cogs", "operating_expenses", "accounts_receivable", "debt")
    )
    + " FROM cy QUALIFY year = max(year) OVER (PARTITION BY company_id)",
    "cy",
)
cte(
    "assumption",
    " UNION ALL ".join(
        f"SELECT company_id, {q(s)} AS scenario_id, {q(c)} AS code, CAST({q(p)} AS INTEGER) AS period, {q(u)} AS unit,"
        f" CAST({'CAST(' + v + ' AS ' + R + ')' if u in ('ratio', 'days') else v} AS {M}) AS value, {q(st)} AS status,"
        f" {q(src)} AS source_type, {i} AS seq FROM lastact WHERE {k}"
        for i, (s, c, p, u, v, st, src, k) in enumerate(D.ASSUMPTIONS)
    ),
    "lastact",
)
cte(
    "lineage",
    "SELECT company_id, scenario_id, scenario_id AS ancestor_id, 0 AS depth FROM scenario UNION ALL "
    "SELECT l.company_id, l.scenario_id, s.parent_id, l.depth + 1 FROM lineage l JOIN scenario s "
    "ON s.company_id = l.company_id AND s.scenario_id = l.ancestor_id WHERE s.parent_id IS NOT NULL",
    "scenario",
)
cte("fyears", values([(y,) for y in D.FORECAST_YEARS], "year", "fy"))
cte(
    "resolved",
    "SELECT company_id, scenario_id, year, code, value, unit, status, source_type, supplied_by, depth FROM ("
    "SELECT l.company_id, l.scenario_id, f.year, a.code, a.value, a.unit, a.status, a.source_type, l.ancestor_id AS supplied_by, l.depth,"
    " row_number() OVER (PARTITION BY l.company_id, l.scenario_id, f.year, a.code ORDER BY (a.period IS NULL), l.depth, a.seq) AS rn"
    " FROM lineage l JOIN assumption a ON a.company_id = l.company_id AND a.scenario_id = l.ancestor_id"
    " JOIN fyears f ON a.period IS NULL OR a.period = f.year) WHERE rn = 1",
    "lineage", "assumption", "fyears",
)
