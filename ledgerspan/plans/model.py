"""The whole model as one pipeline: ledger -> drivers -> forecast -> valuation -> checks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import checks as C
from ..operators import forecast as FC
from ..operators import ledger as L
from ..operators import periods as PD
from ..operators import scenarios as S
from ..operators import valuation as V
from ..session import cut_lineage


@dataclass
class Model:
    """Lazy tables of one portfolio. Nothing runs until a table is written or collected.

    ledger: company_id, statement, account, year, value. scenarios: company_id, scenario_id,
    parent_id, name. assumptions: company_id, scenario_id, code, period, unit, value, status,
    source_type, seq. years: the forecast years, one axis for the portfolio (a company whose actual years do not end right
    before it is refused), or a number of years after each company's own last actual one.
    """

    ledger: DataFrame
    scenarios: DataFrame
    assumptions: DataFrame
    years: tuple[int, ...] | int
    convention: str = "year_end"

    @cached_property
    def wide(self) -> DataFrame:
        return L.to_wide(self.ledger)

    @cached_property
    def filled(self) -> DataFrame:
        return L.fill_with_reported(self.wide)

    @cached_property
    def axis(self) -> DataFrame:
        """Actual and forecast years of each company, and what is wrong with them."""
        return PD.company_axis(self.wide.select("company_id", "year"), self.years)

    @cached_property
    def resolved_all(self) -> DataFrame:
        return S.resolve_all(self.scenarios, self.assumptions, self.axis if isinstance(self.years, int) else self.years)

    @cached_property
    def resolved(self) -> DataFrame:
        return self.resolved_all.where(f"year <> {S.NO_PERIOD}")

    @cached_property
    def opening(self) -> DataFrame:
        return FC.opening_balances(self.filled)

    @cached_property
    def prepared(self) -> DataFrame:
        """One row per company and scenario, ready to forecast or blocked with a reason."""
        return FC.prepare(self.resolved_all, self.scenarios, self.opening, self.years)

    @cached_property
    def status(self) -> DataFrame:
        return FC.status(self.prepared)

    @cached_property
    def forecast(self) -> DataFrame:
        return FC.build(self.prepared)

    @cached_property
    def cost_of_capital(self) -> DataFrame:
        return V.cost_of_capital_table(self.forecast)

    def dcf_years(self, convention: str | None = None, **kw) -> DataFrame:
        return V.dcf_years(self.forecast, convention or self.convention, **kw)

    @cached_property
    def valuation(self) -> DataFrame:
        return V.value(self.dcf_years())

    @cached_property
    def checks(self) -> DataFrame:
        return C.all_checks(self.filled, self.forecast, self.prepared)

    def staged(self, root: str) -> "Model":
        """The same model with ledger, filled rows, assumptions and their resolution, prepared rows, forecast and valuation written
        under `root` (a folder that all executors see) and read from there, so many tables cost one pass over the transactions."""
        out = replace(self)
        for name in ("ledger", "assumptions", "filled", "resolved_all", "prepared", "forecast", "valuation"):
            keys = ("company_id",) if name in ("ledger", "filled") else ()  # these come and are read by company, the others by scenario
            value = cut_lineage(getattr(out, name), *keys, path=f"{root}/{name}")
            value = S.spread(value) if name == "resolved_all" else value  # a file holds many companies in few bytes
            object.__setattr__(out, name, value) if name in ("ledger", "assumptions") else out.__dict__.__setitem__(name, value)
        return out
