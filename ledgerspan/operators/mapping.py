"""Facts to canonical lines: proposals, decision replay, double counting, normalisation.

mapping: document_id, fact_id, account, mapping_type, sign, allocation, approved, version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions import labels as LB
from ..layers import settle, spread
from ..money import MONEY, close
from ..session import cut_lineage
from . import ledger as L


def propose(facts: DataFrame, limit: int = 3, staged: bool = False) -> DataFrame:
    """Ranked accounts per fact; blocked labels and already rejected facts get none.

    The rules run once per distinct label and statement. The join back is a broadcast where the optimizer sees that these are few, else a
    sort-merge join whose hot labels AQE splits. The facts are read twice, so hand in a stage table. staged: the distinct labels are written
    first, so that their number is known when the join is planned, and a broadcast of few moves no fact."""
    clean = settle(facts.withColumn("_label", LB.squeeze(F.col("raw_label"))), facts.columns)
    known = settle(clean.select("_label", "statement").distinct().toDF("_known", "_on"), ())
    known = settle(known.withColumn("candidates", LB.candidates(F.col("_known"), F.col("_on"), limit)), ["_known", "_on"])
    known = cut_lineage(known) if staged else known
    return clean.join(known, (F.col("_label") == F.col("_known")) & F.col("statement").eqNullSafe(F.col("_on"))).select(*facts.columns, "candidates")


def propose_mappings(facts: DataFrame, already: DataFrame | None = None, staged: bool = False) -> DataFrame:
    """The best candidate of every fact not yet mapped, with the sign the chart expects."""
    f = facts if already is None else facts.join(already.select("document_id", "fact_id").distinct(), ["document_id", "fact_id"], "left_anti")
    return (
        propose(f, staged=staged).where(F.size("candidates") > 0)
        .select(
            "document_id", "fact_id", F.col("candidates")[0]["account"].alias("account"), F.col("candidates")[0]["score"].alias("score"),
            F.lit("one_to_one").alias("mapping_type"), LB.infer_sign(F.col("candidates")[0]["account"], F.col("value")).alias("sign"),
            F.lit(None).cast(MONEY).alias("allocation"),
        )
    )


def no_proposal_reason(facts: DataFrame) -> DataFrame:
    """Facts without a proposal: deliberately blocked, or no rule."""
    return propose(facts).where(F.size("candidates") == 0).withColumn(
        "reason", F.coalesce(F.concat(F.lit("blocked: "), LB.blocked_reason(F.col("raw_label"))), F.lit("no rule recognises the label"))
    ).drop("candidates")


def latest_batch(mappings: DataFrame) -> DataFrame:
    """Replay of an append-only mapping log: the newest batch of each fact replaces the earlier ones."""
    w = Window.partitionBy("document_id", "fact_id")
    return spread(mappings, "document_id").withColumn("newest", F.max("version").over(w)).where("version = newest").drop("newest")


def split_violations(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    """Splits whose parts do not add up exactly, name one line twice, or have fewer than two parts."""
    g = mappings.where("mapping_type = 'split'").groupBy("document_id", "fact_id").agg(
        F.sum("allocation").alias("allocated"), F.count("*").alias("parts"), F.count_distinct("account").alias("accounts")
    )
    return g.join(facts.select("document_id", "fact_id", "value"), ["document_id", "fact_id"]).withColumn(
        "problem",
        F.when(F.col("value").isNull(), "no value to divide").when(F.col("parts") < 2, "fewer than two lines").when(F.col("accounts") < F.col("parts"), "line used twice")
        .when(F.col("allocated") != F.col("value"), "does not add up"),
    ).where("problem IS NOT NULL")


def combine_violations(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    """Aggregates over fewer than two facts or across periods."""
    m = mappings.where("mapping_type = 'aggregate'").join(facts.select("document_id", "fact_id", "period_label"), ["document_id", "fact_id"])
    return m.groupBy("document_id", "batch_id").agg(F.count("*").alias("facts"), F.count_distinct("period_label").alias("periods")).where("facts < 2 OR periods > 1")


def _joined(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    f = facts.select("document_id", "fact_id", "page", "raw_label", "raw_value", "period_label", "value", F.col("statement").alias("printed_on"))
    chart = F.broadcast(
        dims.local_table(
            mappings.sparkSession, [(r[0], "|".join(r[1]), r[1][0], len(r[1]) > 1) for r in dims.CHART], "account string, allowed string, first_statement string, on_several boolean"
        )
    )
    m = mappings.where("mapping_type <> 'rejected'").join(f, ["document_id", "fact_id"]).join(chart, "account")
    return m.withColumns(
        {
            "statement": F.when(F.col("on_several"), F.coalesce("printed_on", "first_statement")).otherwise(F.col("first_statement")),
            "contribution": (
                F.when(F.col("mapping_type") == "split", F.col("allocation")).otherwise(F.col("value"))
                * F.when(F.col("sign") == "negated", -1).otherwise(1)
            ).cast(MONEY),
        }
    )


def normalise(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    """(account, period, statement) values; one unreadable contributor makes the line absent, with a reason."""
    return (
        _joined(mappings, facts)
        .groupBy("document_id", "account", "period_label", "statement")
        .agg(
            F.count("*").alias("contributors"),
            F.count_if(F.col("contribution").isNull()).alias("unreadable"),
            F.sum("contribution").alias("total"),
            F.every("approved").alias("approved"),
            F.when(F.count("*") > 1, "aggregate").otherwise(F.first("mapping_type")).alias("mapping_type"),
            F.min_by("page", "fact_id").alias("page"),
        )
        .withColumns(
            {
                "value": F.when(F.col("unreadable") == 0, F.col("total").cast(MONEY)),
                "absent_because": F.when(F.col("unreadable") > 0, F.format_string("%d of %d contributing facts have no parsed value", "unreadable", "contributors")),
            }
        )
        .drop("total", "unreadable")
    )


def citations(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    """Every fact, page and printed string behind a cell (J04, J05, J06). A cell has as many
    contributors as the filing prints for it, so the lists are short."""
    c = _joined(mappings, facts)
    one = F.struct("fact_id", "page", "raw_label", "raw_value", "mapping_type")
    return c.groupBy("document_id", "account", "period_label", "statement").agg(F.array_sort(F.collect_list(one)).alias("facts")).withColumns(
        {
            "labels": F.array_join(F.transform("facts", lambda f: f["raw_label"]), " + "),
            "printed": F.array_join(F.transform("facts", lambda f: f["raw_value"]), " + "),
            "page": F.col("facts")[0]["page"],
        }
    )


def build_ledger(normalised: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reported ledger and the omitted lines with their reason (J03). Strict mode refuses unapproved lines."""
    reason = F.when(F.col("value").isNull(), F.coalesce("absent_because", F.lit("no parsed value"))).when(~F.col("approved"), "mapping not approved")
    n = normalised.withColumns({"reason": reason, "year": F.regexp_extract("period_label", r"(\d{4})", 1).try_cast("int"), "label": engine_year(F.col("period_label"))})
    if strict:
        refused = n.where(F.col("value").isNotNull() & ~F.col("approved"))
        if not refused.isEmpty():
            raise ValueError("a strict build needs every mapping approved")
    ledger = n.where("reason IS NULL AND year IS NOT NULL").select(
        F.col("document_id").alias("company_id"), "statement", "account", "year", "value", F.lit("reported").alias("origin"), "page"
    )
    omitted = n.where("reason IS NOT NULL").select(F.col("document_id").alias("company_id"), "statement", "account", "label", "reason")
    return ledger, omitted


def engine_year(label):
    """2025 -> 2025A; a label already marked keeps its mark."""
    t = F.trim(label)
    return F.when(t.rlike("[AE]$"), t).otherwise(F.concat(t, F.lit("A")))


def double_count_within_fact(mappings: DataFrame) -> DataFrame:
    """One fact mapped to a line twice, or to a line and a subtotal that holds it.

    A fact's own mappings are grouped, never paired: its accounts are tested against their ancestor lists."""
    up = {a: sorted(s) for a, s in dims.ancestors().items()}
    anc = F.broadcast(dims.local_table(mappings.sparkSession, [(a, "|".join(s)) for a, s in up.items()], "account string, ancestors string"))
    g = (
        mappings.where("mapping_type <> 'rejected'").join(anc, "account")
        .groupBy("document_id", "fact_id")
        .agg(F.count("*").alias("n"), F.collect_set("account").alias("accounts"), F.collect_set("ancestors").alias("ancestors"))
        .where("n > 1")
    )
    over = F.array_intersect("accounts", F.split(F.array_join("ancestors", "|"), r"\|"))
    return g.withColumns({"twice": F.col("n") > F.size("accounts"), "counted_inside": F.array_sort(over)}).where("twice OR size(counted_inside) > 0").select(
        "document_id", "fact_id", "twice", "counted_inside"
    )


def double_count_groups(mappings: DataFrame, facts: DataFrame) -> DataFrame:
    """Several facts on one line and period without a declared aggregate."""
    return (
        _joined(mappings, facts)
        .groupBy("document_id", "account", "period_label")
        .agg(
            F.count("*").alias("facts"),
            F.every(F.col("mapping_type") == "aggregate").alias("declared"),
            F.max("on_several").alias("on_several"),
            F.count_distinct("printed_on").alias("printed_on"),
        )
        .where("facts > 1 AND NOT declared AND NOT (on_several AND printed_on > 1)")
        .select("document_id", "account", "period_label", "facts")
    )


def subtotal_findings(normalised: DataFrame) -> DataFrame:
    """Reported subtotals that disagree with their mapped components."""
    w = L.to_wide(normalised.where("value IS NOT NULL").selectExpr("document_id AS company_id", "statement", "account", "period_label AS year", "value"))
    return L.cross_check(w, rel="0.000000001").where(~F.col("agrees")).select(
        F.col("company_id").alias("document_id"), "account", F.col("year").alias("period_label"), F.col("derived").alias("expected"), F.col("reported").alias("actual")
    )


def linkage_findings(normalised: DataFrame) -> DataFrame:
    """Net income printed on two statements that disagrees."""
    n = normalised.where("account = 'net_income' AND value IS NOT NULL").groupBy("document_id", "period_label").agg(
        F.max(F.when(F.col("statement") == "income", F.col("value"))).alias("expected"),
        F.max(F.when(F.col("statement") == "cashflow", F.col("value"))).alias("actual"),
    )
    return n.where("expected IS NOT NULL AND actual IS NOT NULL").where(~close(F.col("expected"), F.col("actual"))).withColumn("account", F.lit("net_income"))


def all_findings(mappings: DataFrame, facts: DataFrame, normalised: DataFrame) -> DataFrame:
    """Every mapping-level finding in one table."""
    none = F.lit(None).cast(MONEY)
    cols = ["document_id", "code", "account", "period_label", "expected", "actual"]
    dup = double_count_groups(mappings, facts).withColumns({"code": F.lit("DOUBLE_COUNTED"), "expected": none, "actual": none}).select(cols)
    sub = subtotal_findings(normalised).withColumn("code", F.lit("SUBTOTAL_MISMATCH")).select(cols)
    link = linkage_findings(normalised).withColumn("code", F.lit("CROSS_STATEMENT_MISMATCH")).select(cols)
    return dup.unionByName(sub).unionByName(link)


def apply_findings(mappings: DataFrame, facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Facts with their mapping codes replaced, never accumulated."""
    hit = _joined(mappings, facts).select("document_id", "fact_id", "account", "period_label").join(findings.select("document_id", "account", "period_label", "code"), ["document_id", "account", "period_label"])
    codes = hit.groupBy("document_id", "fact_id").agg(F.array_sort(F.collect_set("code")).alias("mapping_codes"))
    return facts.drop("mapping_codes").join(codes, ["document_id", "fact_id"], "left").withColumn("mapping_codes", F.coalesce("mapping_codes", F.array().cast("array<string>")))


def approve(mappings: DataFrame, approvals: DataFrame, findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Approval replay: a mapping that double-counts stays unapproved (M07). approvals: document_id, fact_id."""
    bad = _joined(mappings, facts).select("document_id", "fact_id", "account", "period_label").join(
        findings.where("code = 'DOUBLE_COUNTED'").select("document_id", "account", "period_label"), ["document_id", "account", "period_label"]
    ).select("document_id", "fact_id").distinct()
    ok = approvals.select("document_id", "fact_id").distinct().join(bad, ["document_id", "fact_id"], "left_anti").withColumn("ok", F.lit(True))
    return mappings.drop("approved").join(ok, ["document_id", "fact_id"], "left").withColumn("approved", F.coalesce("ok", F.lit(False))).drop("ok")


def fact_mapping_state(mappings: DataFrame) -> DataFrame:
    """Per mapped fact: approved (something contributes, all approved) and excluded."""
    contributes = F.col("mapping_type") != "rejected"
    return mappings.groupBy("document_id", "fact_id").agg(
        (F.max(contributes) & F.every("approved")).alias("mapping_approved"), (~F.max(contributes)).alias("excluded")
    )


def unmapped_facts(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    return facts.join(mappings.select("document_id", "fact_id"), ["document_id", "fact_id"], "left_anti")


def statement_bookmarks(cells: DataFrame) -> DataFrame:
    """(page, statement) pairs a table caption names, once each."""
    return cells.select("document_id", "page", LB.statement_of_caption(F.col("caption")).alias("statement")).where("statement IS NOT NULL").distinct()


def version_history(mappings: DataFrame) -> DataFrame:
    """Mapping versions per document with the one each supersedes."""
    v = mappings.groupBy("document_id", "version").agg(F.count("*").alias("mappings"))
    w = Window.partitionBy("document_id").orderBy("version")
    return v.withColumns({"supersedes": F.lag("version").over(w), "current": F.col("version") == F.max("version").over(Window.partitionBy("document_id"))})


def trace(mappings: DataFrame, facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every ledger cell with the facts, pages and decisions behind it."""
    # a citation has a fact at least, so that one is there says it all, and who asks no more builds no lists
    c = citations(mappings, facts).selectExpr("document_id AS company_id", "statement", "account", "CAST(regexp_extract(period_label, '(\\\\d{4})', 1) AS INT) AS year", "facts", "printed", "page AS cited_page", "true AS _cited")
    return ledger.join(c, ["company_id", "statement", "account", "year"], "left").withColumn("has_lineage", F.coalesce("_cited", F.lit(False))).drop("_cited")


def trace_facts(mappings: DataFrame, facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every ledger cell with each fact behind it: where it was printed, how it was mapped, and what review decided."""
    c = _joined(mappings, facts).join(facts.select("document_id", "fact_id", "action", "actor", F.col("reason").alias("decided_because")), ["document_id", "fact_id"])
    c = c.selectExpr("document_id AS company_id", "statement", "account", "CAST(regexp_extract(period_label, '(\\\\d{4})', 1) AS INT) AS year", "fact_id", "page AS fact_page", "raw_label", "raw_value", "mapping_type", "contribution", "action", "actor", "decided_because")
    return ledger.select("company_id", "statement", "account", "year", "value").join(c, ["company_id", "statement", "account", "year"], "left")


def cell_checks(mappings: DataFrame, facts: DataFrame, ledger: DataFrame, gated: DataFrame) -> DataFrame:
    """Two checks per company: every historical cell cites a page (C10), and rests on verified facts (C11)."""
    key = ["company_id", "statement", "account", "year"]
    c = _joined(mappings, facts).join(gated.select("document_id", "fact_id", "verified"), ["document_id", "fact_id"], "left")
    c = c.selectExpr("document_id AS company_id", "statement", "account", "CAST(regexp_extract(period_label, '(\\\\d{4})', 1) AS INT) AS year", "page", "verified")
    # the facts of a cell are judged before they meet the ledger
    per = c.groupBy(*key).agg(F.max(F.col("page").isNotNull()).alias("has_page"), F.every(F.coalesce("verified", F.lit(False))).alias("all_verified"))
    cell = ledger.select(*key).join(per, key, "left").groupBy(*key).agg(F.max(F.coalesce("has_page", F.lit(False))).alias("cited"), F.every(F.coalesce("all_verified", F.lit(False))).alias("sound"))
    n = cell.groupBy("company_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("cited")).alias("bare"), F.count_if(~F.col("sound")).alias("unsound"))
    return n.selectExpr("company_id", "cells", L.stacked([("'every cell cites a page'", "bare"), ("'every cell is verified'", "unsound")], ("check_name", "broken"))).withColumn("status", F.when(F.col("broken") > 0, "FAIL").otherwise("PASS"))
