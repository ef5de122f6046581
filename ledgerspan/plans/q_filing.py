"""Registered queries: cells, facts, mapping, review, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import amounts as A
from ..functions import labels as LB
from ..operators import exports as EX
from ..operators import facts as FA
from ..operators import mapping as MP
from ..operators import review as RV
from ..session import cut_lineage
from ..sources import derived as D
from ..sources import filings as FL
from .duck import M, cte, q, sql, values
from .q_ledger import close_sql
from .registry import as_double, dbl, register, sd

_ROWS = values([(a, FL.ROWS[a], lab) for a, lab in FL.LABELS], "account, rw, raw_label", "lb")
_RULES = values([(c, p, s, "|".join(LB._STATEMENTS[c])) for c, p, s in LB.RULES], "code, pattern, score, statements", "r")
_BLOCK = values([(p, r) for p, r in LB.BLOCKED], "pattern, reason", "b")

# What every cell of the derived filings must parse to, straight from the ledger.
cte("labelmap", f"SELECT account, rw, raw_label FROM ({_ROWS})")
cte(
    "xfacts",
    "SELECT l.company_id AS document_id, l.statement, m.account, m.rw AS rw, m.raw_label, l.year - 1994 AS cl, CAST(l.year AS VARCHAR) AS period_label, l.company_id, l.year,"
    f" CASE WHEN NOT ({FL.DASH_WHEN}) THEN CAST(round_even(abs(l.value), 2) AS {M}) * CASE WHEN (l.value < 0) <> ({FL.FLIPPED_WHEN.replace('account', 'm.account')}) THEN -1 ELSE 1 END END AS parsed,"
    f" {FL.DASH_WHEN} AS dashed, {FL.FOOTNOTE_WHEN} AS footnoted, l.company_id % 10 = 4 AND l.statement = 'balance' AS repeated, l.company_id || '-' || CASE l.statement WHEN 'income' THEN 1 WHEN 'balance' THEN 2 ELSE 3 END AS table_id,"
    " CASE l.statement WHEN 'income' THEN 1 WHEN 'balance' THEN 2 ELSE 3 END AS page"
    " FROM ledger l JOIN labelmap m ON m.account = l.account", "ledger", "labelmap")
cte(
    "ffacts",
    "SELECT *, table_id || '-' || rw || '-' || cl AS fact_id, CAST((8 - dashed::INT - footnoted::INT - repeated::INT) / 8.0 AS DOUBLE) AS confidence,"
    f" concat_ws(',', CASE WHEN footnoted THEN 'FOOTNOTE_MARKER_STRIPPED' END, CASE WHEN dashed THEN 'DASH_AMBIGUOUS' END, CASE WHEN NOT ({FL.SCALE_OK}) THEN 'SCALE_UNCONFIRMED' END, CASE WHEN NOT ({FL.CURRENCY_OK}) THEN 'CURRENCY_UNCONFIRMED' END,"
    " CASE WHEN company_id % 10 = 3 THEN 'SCOPE_AMBIGUOUS' END, CASE WHEN repeated THEN 'HEADER_REPEATED' END, CASE WHEN dashed::INT + footnoted::INT + repeated::INT >= 2 THEN 'LOW_CONFIDENCE' END) AS codes FROM xfacts", "xfacts")
_BLOCKING = "regexp_matches(codes, 'DASH_AMBIGUOUS|SCALE_UNCONFIRMED|CURRENCY_UNCONFIRMED|SCOPE_AMBIGUOUS|LOW_CONFIDENCE')"


@register("m12_build_facts", sql("SELECT document_id, fact_id, raw_label, period_label, " + sd("parsed", "value") + ", confidence, codes, " + _BLOCKING + " OR confidence < 0.875 AS needs_review FROM ffacts", "ffacts"))
def m12(spark, sf):
    f = FL.facts(spark, sf)
    return f.select("document_id", "fact_id", "raw_label", "period_label", dbl("parsed.value").alias("value"), F.col("confidence").cast("double").alias("confidence"), F.array_join("reason_codes", ",").alias("codes"), "needs_review")


@register("p02_parse_amounts", sql(
    "SELECT style, CAST(count(*) AS BIGINT) AS cells, CAST(count(value) AS BIGINT) AS parsed, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT style, CASE style WHEN 'dash' THEN NULL WHEN 'written_zero' THEN 0"
    " WHEN 'unconfirmed' THEN CASE WHEN px < 1000 THEN NULL WHEN px < 1000000 THEN NULL ELSE floor(px) END ELSE CASE WHEN rf = 'R' THEN -px ELSE px END END AS value FROM ("
    " SELECT CAST(l_extendedprice AS DECIMAL(12,2)) AS px, l_returnflag AS rf, CASE l_linenumber WHEN 1 THEN 'us' WHEN 2 THEN 'eu' WHEN 3 THEN 'swiss' WHEN 4 THEN 'dash' WHEN 5 THEN 'written_zero' WHEN 6 THEN 'symbol' ELSE 'footnote' END AS style FROM lineitem)) GROUP BY style"))
def p02(spark, sf):
    """Every line item's price printed in one of seven styles and read back."""
    n = "format_number(CAST(l_extendedprice AS DECIMAL(12,2)), 2)"
    neg = f"CASE WHEN l_returnflag = 'R' THEN concat('(', {{}}, ')') ELSE {{}} END"
    eu = f"translate({n}, ',.', '.,')"
    swiss = f"translate({n}, ',', '’')"
    dollar = f"concat('$ ', {n})"
    text = (
        f"CASE l_linenumber WHEN 1 THEN {neg.format(n, n)} WHEN 2 THEN {neg.format(eu, eu)} WHEN 3 THEN {neg.format(swiss, swiss)} WHEN 4 THEN '–' WHEN 5 THEN 'nil'"
        f" WHEN 6 THEN CASE WHEN l_returnflag = 'R' THEN concat('$ (', {n}, ')') ELSE {dollar} END ELSE concat({neg.format(n, n)}, '(3)†') END"
    )
    style = "CASE l_linenumber WHEN 1 THEN 'us' WHEN 2 THEN 'eu' WHEN 3 THEN 'swiss' WHEN 4 THEN 'dash' WHEN 5 THEN 'written_zero' WHEN 6 THEN 'symbol' ELSE 'footnote' END"
    cells = D.table(spark, sf, "lineitem").selectExpr(f"{style} AS style", f"{text.replace('(3)†', '(3)')} AS raw_value", "CASE l_linenumber WHEN 2 THEN 'comma_decimal' ELSE 'dot_decimal' END AS locale")
    return A.parse_amounts(cells).groupBy("style").agg(F.count("*").alias("cells"), F.count("parsed.value").alias("parsed"), F.sum("parsed.value").cast("double").alias("total"))


@register("p06_interpret_locale", sql(
    "SELECT l_linenumber, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE k >= 1000000) AS BIGINT) AS one_reading, CAST(count(*) FILTER (WHERE k >= 1000 AND k < 1000000) AS BIGINT) AS two_readings FROM (SELECT l_linenumber, CAST(floor(CAST(l_extendedprice AS DECIMAL(12,2)) * 20) AS BIGINT) AS k FROM lineitem) GROUP BY l_linenumber"))
def p06(spark, sf):
    """Whole amounts with one group separator stay unread without a locale; two groups settle it."""
    c = D.table(spark, sf, "lineitem").selectExpr("l_linenumber", "format_number(CAST(floor(CAST(l_extendedprice AS DECIMAL(12,2)) * 20) AS BIGINT), 0) AS raw_value", "'unknown' AS locale")
    p = A.parse_amounts(c)
    return p.groupBy("l_linenumber").agg(
        F.count("*").alias("cells"), F.count_if((F.col("parsed.locale_used") == "dot_decimal")).alias("one_reading"), F.count_if(F.array_contains("parsed.codes", "SEPARATOR_AMBIGUOUS")).alias("two_readings"))


@register("p08_period_label", sql(
    "SELECT style, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE style IN ('qualified', 'quarter')) AS BIGINT) AS ambiguous, min(CASE style WHEN 'qualified' THEN y || ' (restated)' WHEN 'quarter' THEN 'Q1 ' || y ELSE y END) AS first_label FROM ("
    "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, CASE o_orderkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'dated' WHEN 2 THEN 'qualified' ELSE 'quarter' END AS style FROM orders) GROUP BY style"))
def p08(spark, sf):
    o = D.table(spark, sf, "orders").selectExpr("year(o_orderdate) AS y", "CASE o_orderkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'dated' WHEN 2 THEN 'qualified' ELSE 'quarter' END AS style")
    t = o.selectExpr("style", "CASE style WHEN 'plain' THEN concat('FY', y) WHEN 'dated' THEN concat('December 31, ', y) WHEN 'qualified' THEN concat(y, ' (restated)') ELSE concat('Q1 ', y) END AS text")
    p = t.withColumn("p", LB.period_label(F.col("text")))
    return p.groupBy("style").agg(F.count("*").alias("n"), F.count_if("p.ambiguous").alias("ambiguous"), F.min("p.label").alias("first_label"))


_CAP = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Consolidated Balance Sheets' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Results by Segment: Income Statement' WHEN c_mktsegment = 'MACHINERY' THEN 'Parent company only cash flows' ELSE 'Notes' END"


@register("p09_scope_of_caption", sql(
    "SELECT caption, CASE WHEN caption LIKE 'Consolidated%' THEN 'consolidated' WHEN caption LIKE '%Segment%' THEN 'segment' WHEN caption LIKE 'Parent%' THEN 'parent' ELSE 'undetermined' END AS scope,"
    " CASE WHEN caption LIKE '%Income Statement' THEN 'income' WHEN caption LIKE '%Balance Sheets' THEN 'balance' WHEN caption LIKE '%cash flows' THEN 'cashflow' END AS statement, CAST(count(*) AS BIGINT) AS n FROM (SELECT " + _CAP + " AS caption FROM customer) GROUP BY 1, 2, 3"))
def p09(spark, sf):
    c = D.table(spark, sf, "customer").selectExpr(f"{_CAP} AS caption")
    return c.select("caption", LB.scope_of_caption(F.col("caption")).alias("scope"), LB.statement_of_caption(F.col("caption")).alias("statement")).groupBy("caption", "scope", "statement").agg(F.count("*").alias("n"))


@register("w10_header_row", sql(
    "SELECT DISTINCT document_id, table_id, CAST(0 AS INTEGER) AS header_row, CAST(min(cl) OVER (PARTITION BY table_id) AS INTEGER) AS first_value_column, repeated AS has_repeats FROM ffacts"
    " UNION ALL SELECT DISTINCT company_id, company_id || '-4', NULL, 1, FALSE FROM ledger WHERE statement = 'cashflow' AND company_id % 6 = 1", "ffacts"))
def w10(spark, sf):
    return FA.header_rows(FL.raw_cells(spark, sf)).select("document_id", "table_id", "header_row", "first_value_column", "has_repeats").distinct()


@register("w09_table_split_flag", sql(
    "SELECT DISTINCT document_id, table_id, page, FALSE AS continues FROM ffacts UNION ALL SELECT DISTINCT company_id, company_id || '-4', 4, TRUE FROM ledger WHERE statement = 'cashflow' AND company_id % 6 = 1", "ffacts"))
def w09(spark, sf):
    return FA.table_splits(FL.raw_cells(spark, sf)).select("document_id", "table_id", "page", "continues")


@register("s06_read_raw_cells", sql(
    "SELECT page, CAST(count(*) AS BIGINT) AS cells FROM (SELECT page, fact_id FROM ffacts UNION ALL SELECT DISTINCT page, table_id || '-' || rw FROM ffacts UNION ALL SELECT DISTINCT page, table_id || '-' || cl || h.k FROM ffacts, (SELECT unnest([0, 99]) AS k) h WHERE h.k = 0 OR repeated"
    " UNION ALL SELECT DISTINCT page, table_id || 'c' || h.k FROM ffacts, (SELECT unnest([0, 99]) AS k) h WHERE h.k = 0 OR repeated UNION ALL SELECT page, table_id FROM (SELECT DISTINCT page, table_id FROM ffacts), range(8)"
    " UNION ALL SELECT 4, company_id FROM (SELECT DISTINCT company_id FROM ledger WHERE company_id % 6 = 1), range(8)) GROUP BY page", "ffacts"))
def s06(spark, sf):
    return FL.raw_cells(spark, sf).groupBy("page").agg(F.count("*").alias("cells"))


@register("l05_confidence_histogram", sql("SELECT document_id, confidence, CAST(count(*) AS BIGINT) AS facts, min(fact_id) AS example FROM ffacts GROUP BY 1, 2", "ffacts"))
def l05(spark, sf):
    return FA.confidence_histogram(FL.facts(spark, sf)).withColumn("confidence", F.col("confidence").cast("double"))


@register("l04_review_queue", sql(
    "SELECT document_id, fact_id, code FROM (SELECT document_id, fact_id, unnest(string_split(codes, ',')) AS code FROM ffacts WHERE codes <> '') WHERE code IN (" + ", ".join(q(c) for c in dims.BLOCKING) + ")", "ffacts"))
def l04(spark, sf):
    f = FL.facts(spark, sf).withColumn("resolved_codes", F.array().cast("array<string>"))
    return FA.review_queue(f).select("document_id", "fact_id", "code")


@register("p17_reason_registry", sql(
    "SELECT code, code IN (" + ", ".join(q(c) for c in dims.BLOCKING) + ") AS blocking, CAST(count(*) AS BIGINT) AS facts FROM (SELECT unnest(string_split(codes, ',')) AS code FROM ffacts WHERE codes <> '') GROUP BY 1, 2", "ffacts"))
def p17(spark, sf):
    return FL.facts(spark, sf).select(F.explode("reason_codes").alias("code")).join(F.broadcast(dims.reason_df(spark).select("code", "blocking")), "code").groupBy("code", "blocking").agg(F.count("*").alias("facts"))


# ---- review -----------------------------------------------------------------------------------
cte(
    "xrev",
    "SELECT *, CASE WHEN status = 'corrected' THEN CAST(100 AS DECIMAL(25,8)) ELSE parsed END AS value,"
    " list_filter(string_split(codes, ','), lambda c: c IN (" + ", ".join(q(c) for c in dims.BLOCKING) + ") AND (status = 'rejected' OR c IN ('SCALE_UNCONFIRMED', 'CURRENCY_UNCONFIRMED'))) AS outstanding FROM ("
    "SELECT *, CASE WHEN (document_id + rw + cl) % 17 = 0 AND cl = 4 THEN 'accepted' WHEN parsed IS NULL THEN 'corrected' WHEN (document_id + rw + cl) % 17 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM ffacts)", "ffacts")


@register("m09_review_decisions", sql("SELECT document_id, fact_id, status, " + sd("value", "value") + ", array_to_string(list_sort(outstanding), ',') AS outstanding FROM xrev", "xrev"))
def m09(spark, sf):
    r = FL.Filing(spark, sf).reviewed
    return r.select("document_id", "fact_id", "status", dbl("value").alias("value"), F.array_join(F.array_sort("outstanding"), ",").alias("outstanding"))


@register("w13_latest_decision", sql("SELECT document_id, fact_id, CASE status WHEN 'accepted' THEN 'accept' WHEN 'corrected' THEN 'correct' ELSE 'reject' END AS action FROM xrev", "xrev"))
def w13(spark, sf):
    return RV.latest_decision(FL.Filing(spark, sf).decisions).select("document_id", "fact_id", "action")


@register("m09_decision_violations", sql(
    f"SELECT document_id, fact_id, CASE WHEN NOT ({FL.SCALE_OK} AND {FL.CURRENCY_OK}) THEN 'document not confirmed' END AS problem FROM ffacts WHERE NOT ({FL.SCALE_OK} AND {FL.CURRENCY_OK}) AND parsed IS NOT NULL AND (document_id + rw + cl) % 17 <> 0"
    f" UNION ALL SELECT document_id, fact_id, CASE WHEN parsed IS NULL THEN 'no value to accept' ELSE 'document not confirmed' END FROM ffacts WHERE (document_id + rw + cl) % 17 = 0 AND cl = 4 AND (parsed IS NULL OR NOT ({FL.SCALE_OK} AND {FL.CURRENCY_OK}))", "ffacts"))
def m09v(spark, sf):
    f = cut_lineage(FL.facts(spark, sf))
    return RV.decision_violations(FL.decisions(f), f).select("document_id", "fact_id", "problem")


@register("m10_confirm_fields", sql("SELECT s_suppkey AS document_id, concat_ws(',', CASE WHEN s_suppkey % 9 = 8 THEN 'reporting_currency' END, CASE WHEN s_suppkey % 8 = 7 THEN 'displayed_scale' END) AS missing FROM supplier"))
def m10(spark, sf):
    d = FL.documents(spark, sf)
    rows = d.selectExpr(
        "document_id", "stack(4, 'displayed_scale', 'thousands', 1L, 'unconfirmed', 'reporting_currency', 'USD', 2L, 'unconfirmed', 'displayed_scale', 'thousands', 3L, CASE WHEN scale_confirmed THEN 'confirmed' ELSE 'unconfirmed' END,"
        " 'reporting_currency', 'EUR', 4L, CASE WHEN currency_confirmed THEN 'corrected' ELSE 'unconfirmed' END) AS (field, value, event_id, state)", ).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    c = RV.confirmed_fields(rows, ("displayed_scale", "reporting_currency"))
    return c.select("document_id", F.concat_ws(",", F.when(F.array_contains("unconfirmed", "reporting_currency"), "reporting_currency"), F.when(F.array_contains("unconfirmed", "displayed_scale"), "displayed_scale")).alias("missing"))


# ---- mapping ----------------------------------------------------------------------------------
cte("distinctlabels", "SELECT DISTINCT raw_label, statement FROM xfacts", "xfacts")
cte(
    "cand",
    "SELECT raw_label, statement, code, max(score) AS score FROM distinctlabels d JOIN (" + _RULES + ") r ON regexp_matches(d.raw_label, '(?i)' || r.pattern) AND list_contains(string_split(r.statements, '|'), d.statement)"
    " WHERE NOT EXISTS (SELECT 1 FROM (" + _BLOCK + ") b WHERE regexp_matches(d.raw_label, b.pattern)) GROUP BY 1, 2, 3", "distinctlabels")
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY raw_label, statement ORDER BY score DESC, code) AS rn FROM cand", "cand")


@register("t01_propose_top3", sql("SELECT f.document_id, f.fact_id, CAST(r.rn AS INTEGER) AS rank, r.code AS account, CAST(r.score AS INTEGER) AS score FROM ffacts f JOIN ranked r USING (raw_label, statement) WHERE r.rn <= 3", "ffacts", "ranked"))
def t01(spark, sf):
    p = MP.propose(cut_lineage(FL.facts(spark, sf))).select("document_id", "fact_id", F.posexplode("candidates").alias("pos", "c"))
    return p.select("document_id", "fact_id", (F.col("pos") + 1).alias("rank"), "c.account", "c.score")


_SIGNS = values([(r[0], r[2]) for r in dims.CHART], "code, expected", "sg")
cte("prop",
    "SELECT f.document_id, f.fact_id, f.raw_label, f.cl, f.value, f.period_label, f.statement, r.code AS account, CASE WHEN (sg.expected = 'positive' AND f.value < 0) OR (sg.expected = 'negative' AND f.value > 0) THEN 'negated' ELSE 'as_printed' END AS sign"
    " FROM xrev f JOIN ranked r USING (raw_label, statement) JOIN (" + _SIGNS + ") sg ON sg.code = r.code WHERE r.rn = 1 AND f.status <> 'rejected'", "xrev", "ranked")
_lab = dict(FL.LABELS)
cte("mlog",
    f"SELECT document_id, fact_id, account, 'one_to_one' AS mapping_type, sign, CAST(NULL AS {M}) AS allocation, 1 AS version FROM prop"
    f" UNION ALL SELECT document_id, fact_id, s.account, 'split', 'as_printed', CAST(CASE s.account WHEN 'inventory' THEN round(value * 0.4, 2) ELSE value - round(value * 0.4, 2) END AS {M}), 2 FROM prop, (SELECT unnest(['inventory', 'other_current_assets']) AS account) s WHERE document_id % 15 = 2 AND raw_label = {q(_lab['other_current_assets'])} AND cl = 6 AND value IS NOT NULL"
    f" UNION ALL SELECT document_id, fact_id, 'inventory', 'one_to_one', 'as_printed', NULL, 2 FROM prop WHERE document_id % 14 = 6 AND raw_label = {q(_lab['other_noncurrent_assets'])}"
    f" UNION ALL SELECT document_id, fact_id, s.account, 'one_to_one', 'as_printed', NULL, 2 FROM prop, (SELECT unnest(['cogs', 'gross_profit']) AS account) s WHERE document_id % 14 = 6 AND raw_label = {q(_lab['cogs'])}", "prop")
cte("maps", "SELECT * EXCLUDE (mx) FROM (SELECT *, max(version) OVER (PARTITION BY document_id, fact_id) AS mx FROM mlog) WHERE version = mx", "mlog")
cte("mj", "SELECT m.*, f.value, f.period_label, f.statement AS printed_on, f.page, f.raw_label, CASE WHEN m.account = 'net_income' THEN f.statement ELSE c.st END AS statement, CASE WHEN m.mapping_type = 'split' THEN m.allocation ELSE f.value END * CASE WHEN m.sign = 'negated' THEN -1 ELSE 1 END AS contribution"
    " FROM maps m JOIN xrev f USING (document_id, fact_id) JOIN (" + values([(r[0], r[1][0]) for r in dims.CHART], "account, st", "c") + ") c ON c.account = m.account", "maps", "xrev")
cte("norm", f"SELECT document_id, account, period_label, statement, count(*) AS contributors, CASE WHEN count(*) = count(contribution) THEN CAST(sum(contribution) AS {M}) END AS value, min(page) AS page FROM mj GROUP BY 1, 2, 3, 4", "mj")


@register("m01_propose_mappings", sql("SELECT document_id, fact_id, account, sign FROM prop", "prop"))
def m01(spark, sf):
    r = FL.Filing(spark, sf).reviewed
    return MP.propose_mappings(r.where("status <> 'rejected'")).select("document_id", "fact_id", "account", "sign")


@register("m02_no_proposal_reason", sql(
    "SELECT label, CASE WHEN label LIKE 'Total current%' THEN 'blocked: no current-total line in the chart' WHEN label LIKE '%per share' THEN 'blocked: per-share figure or share count' ELSE 'no rule recognises the label' END AS reason, CAST(count(*) AS BIGINT) AS n FROM ("
    "SELECT CASE p_size % 4 WHEN 0 THEN 'Total current assets' WHEN 1 THEN 'Basic earnings per share' WHEN 2 THEN p_name ELSE 'Total current liabilities' END AS label FROM part) GROUP BY 1, 2"))
def m02(spark, sf):
    p = D.table(spark, sf, "part").selectExpr("CASE p_size % 4 WHEN 0 THEN 'Total current assets' WHEN 1 THEN 'Basic earnings per share' WHEN 2 THEN p_name ELSE 'Total current liabilities' END AS raw_label", "CAST(NULL AS STRING) AS statement")
    return MP.no_proposal_reason(p).groupBy(F.col("raw_label").alias("label"), "reason").agg(F.count("*").alias("n"))


@register("j01_normalize", sql("SELECT document_id, account, period_label, statement, CAST(contributors AS BIGINT) AS contributors, " + sd("value", "value") + ", document_id % 12 <> 11 AS approved FROM norm", "norm"))
def j01(spark, sf):
    f = FL.Filing(spark, sf)
    return as_double(MP.normalise(f.mappings, f.reviewed).select("document_id", "account", "period_label", "statement", "contributors", "value", "approved"), "value")


@register("j03_build_ledger", sql(
    "SELECT document_id AS company_id, statement, account, CAST(period_label AS INTEGER) AS year, " + sd("value", "value") + ", page FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11", "norm"))
def j03(spark, sf):
    f = FL.Filing(spark, sf)
    led, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    return as_double(led.drop("origin"), "value")


@register("j03_omitted_lines", sql(
    "SELECT document_id AS company_id, statement, account, period_label || 'A' AS label, CASE WHEN value IS NULL THEN '1 of 1 contributing facts have no parsed value' ELSE 'mapping not approved' END AS reason FROM norm WHERE value IS NULL OR document_id % 12 = 11", "norm"))
def j03b(spark, sf):
    f = FL.Filing(spark, sf)
    return MP.build_ledger(MP.normalise(f.mappings, f.reviewed))[1]


@register("j06_citations", sql(
    "SELECT document_id, account, period_label, statement, string_agg(raw_label, ' + ' ORDER BY fact_id) AS labels, CAST(count(*) AS INTEGER) AS facts, arg_min(page, fact_id) AS page FROM mj GROUP BY 1, 2, 3, 4", "mj"))
def j06(spark, sf):
    f = FL.Filing(spark, sf)
    return MP.citations(f.mappings, f.reviewed).select("document_id", "account", "period_label", "statement", "labels", F.size("facts").alias("facts"), "page")


@register("j31_double_count_within_fact", sql("SELECT document_id, fact_id, string_agg(DISTINCT b.ancestor, ',') AS counted_inside FROM (SELECT a.document_id, a.fact_id, c.ancestor FROM maps a JOIN (" + values([(a, u) for a, us in dims.ancestors().items() for u in sorted(us)], "account, ancestor", "c") + ") c USING (account) JOIN maps o ON o.document_id = a.document_id AND o.fact_id = a.fact_id AND o.account = c.ancestor) b GROUP BY 1, 2", "maps"))
def j31(spark, sf):
    return MP.double_count_within_fact(FL.Filing(spark, sf).mappings).select("document_id", "fact_id", F.array_join("counted_inside", ",").alias("counted_inside"))


cte("dbl", "SELECT document_id, account, period_label, count(*) AS facts FROM mj GROUP BY 1, 2, 3 HAVING count(*) > 1 AND NOT bool_and(mapping_type = 'aggregate') AND NOT (account = 'net_income' AND count(DISTINCT printed_on) > 1)", "mj")


@register("a14_double_count_groups", sql("SELECT document_id, account, period_label, CAST(facts AS BIGINT) AS facts FROM dbl", "dbl"))
def a14(spark, sf):
    f = FL.Filing(spark, sf)
    return MP.double_count_groups(f.mappings, f.reviewed)


@register("m04_split_facts", sql("SELECT document_id, fact_id, " + sd("sum(allocation)", "allocated") + ", " + sd("any_value(value)", "value") + ", CAST(count(*) AS BIGINT) AS parts FROM mj WHERE mapping_type = 'split' GROUP BY 1, 2", "mj"))
def m04(spark, sf):
    f = FL.Filing(spark, sf)
    bad = MP.split_violations(f.mappings, f.reviewed).select("document_id", "fact_id")
    g = f.mappings.where("mapping_type = 'split'").groupBy("document_id", "fact_id").agg(F.sum("allocation").alias("allocated"), F.count("*").alias("parts"))
    g = g.join(f.reviewed.select("document_id", "fact_id", "value"), ["document_id", "fact_id"]).join(bad, ["document_id", "fact_id"], "left_anti")
    return as_double(g, "allocated", "value")


_DERW = ", ".join(f"MAX(CASE WHEN statement = '{s}' AND account = '{a}' THEN value END) AS {p}{a}" for s, a, p in [(s, a, {'income': 'is_', 'balance': 'bs_', 'cashflow': 'cf_'}[s]) for s, a in dims.slots()])
cte("nwide", f"SELECT document_id AS company_id, period_label AS year, {_DERW} FROM norm GROUP BY 1, 2", "norm")


def _nsub() -> str:
    from .q_ledger import _drv_rows

    return _drv_rows("nwide")


cte("nsub", _nsub(), "nwide")


@register("u01_all_findings", sql(
    "SELECT document_id, 'DOUBLE_COUNTED' AS code, account, period_label FROM dbl UNION ALL SELECT company_id, 'SUBTOTAL_MISMATCH', account, year FROM nsub WHERE reported IS NOT NULL AND derived IS NOT NULL AND NOT (" + close_sql("reported", "derived") + ")"
    " UNION ALL SELECT company_id, 'CROSS_STATEMENT_MISMATCH', 'net_income', year FROM nwide WHERE is_net_income IS NOT NULL AND cf_net_income IS NOT NULL AND NOT (" + close_sql("is_net_income", "cf_net_income") + ")", "dbl", "nsub", "nwide"))
def u01(spark, sf):
    f = FL.Filing(spark, sf)
    return MP.all_findings(f.mappings, f.reviewed, MP.normalise(f.mappings, f.reviewed)).select("document_id", "code", "account", "period_label")


@register("m11_verification_gates", sql(
    "SELECT document_id, fact_id, done AS review_complete, done AND COALESCE(mapped, FALSE) AS verified, mapped IS NULL AS unmapped FROM (SELECT x.document_id, x.fact_id, x.status IN ('accepted', 'corrected') AND len(x.outstanding) = 0"
    f" AND ({FL.SCALE_OK}) AND ({FL.CURRENCY_OK}) AS done, m.document_id % 12 <> 11 AS mapped FROM xrev x LEFT JOIN (SELECT DISTINCT document_id, fact_id FROM maps) m USING (document_id, fact_id))", "xrev", "maps"))
def m11(spark, sf):
    f = FL.Filing(spark, sf)
    return RV.gates(f.reviewed, MP.fact_mapping_state(f.mappings), f.documents).select("document_id", "fact_id", "review_complete", "verified", "unmapped")


cte("xgate", f"SELECT x.document_id, x.page, x.status, len(x.outstanding) > 0 AS open, x.status IN ('accepted', 'corrected') AND len(x.outstanding) = 0 AND ({FL.SCALE_OK}) AND ({FL.CURRENCY_OK}) AS done, m.document_id % 12 <> 11 AS mapped FROM xrev x LEFT JOIN (SELECT DISTINCT document_id, fact_id FROM maps) m USING (document_id, fact_id)", "xrev", "maps")
_PROG = ("CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS decided, CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE status = 'corrected') AS BIGINT) AS corrected, CAST(count(*) FILTER (WHERE status = 'rejected') AS BIGINT) AS rejected,"
         " CAST(count(*) FILTER (WHERE open) AS BIGINT) AS unresolved, CAST(count(*) FILTER (WHERE done) AS BIGINT) AS review_complete, CAST(count(*) FILTER (WHERE done AND mapped) AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE mapped) AS BIGINT) AS mapped_and_approved,"
         " CAST(0 AS BIGINT) AS excluded, CAST(count(*) FILTER (WHERE mapped IS NULL) AS BIGINT) AS unmapped, CAST(100 AS BIGINT) AS percent_decided")


@register("a07_review_progress", sql(f"SELECT document_id, {_PROG} FROM xgate GROUP BY document_id", "xgate"))
def a07(spark, sf):
    f = FL.Filing(spark, sf)
    return RV.progress(RV.gates(f.reviewed, MP.fact_mapping_state(f.mappings), f.documents))


@register("a08_page_progress", sql(f"SELECT document_id, page, {_PROG} FROM xgate GROUP BY document_id, page", "xgate"))
def a08(spark, sf):
    f = FL.Filing(spark, sf)
    return RV.progress(RV.gates(f.reviewed, MP.fact_mapping_state(f.mappings), f.documents), "page")


@register("j23_unmapped_facts", sql("SELECT document_id, fact_id FROM xrev WHERE status = 'rejected'", "xrev"))
def j23(spark, sf):
    f = FL.Filing(spark, sf)
    return MP.unmapped_facts(f.reviewed, f.mappings).select("document_id", "fact_id")


@register("w14_version_history", sql("SELECT document_id, version, CAST(count(*) AS BIGINT) AS mappings, lag(version) OVER (PARTITION BY document_id ORDER BY version) AS supersedes, version = max(version) OVER (PARTITION BY document_id) AS current FROM mlog GROUP BY document_id, version", "mlog"))
def w14(spark, sf):
    return MP.version_history(FL.Filing(spark, sf).log)


@register("j38_statement_bookmarks", sql("SELECT DISTINCT document_id, page, statement FROM ffacts UNION ALL SELECT DISTINCT company_id, 4, 'cashflow' FROM ledger WHERE statement = 'cashflow' AND company_id % 6 = 1", "ffacts"))
def j38(spark, sf):
    return MP.statement_bookmarks(FL.raw_cells(spark, sf))


@register("j37_lineage_trace", sql("SELECT document_id AS company_id, statement, account, CAST(period_label AS INTEGER) AS year, TRUE AS has_lineage, CAST(contributors AS INTEGER) AS facts FROM norm WHERE value IS NOT NULL AND document_id % 12 <> 11", "norm"))
def j37(spark, sf):
    f = FL.Filing(spark, sf)
    led, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    return MP.trace(f.mappings, f.reviewed, led).select("company_id", "statement", "account", "year", "has_lineage", F.size("facts").alias("facts"))


_ACTION = "CASE x.status WHEN 'accepted' THEN 'accept' WHEN 'corrected' THEN 'correct' ELSE 'reject' END"


@register("j37_lineage_facts", sql(
    "SELECT n.document_id AS company_id, n.statement, n.account, CAST(n.period_label AS INTEGER) AS year, m.fact_id, m.page AS fact_page, m.raw_label, m.mapping_type, " + sd("m.contribution", "contribution") + f", {_ACTION} AS action,"
    " CASE WHEN (x.document_id + x.rw + x.cl) % 17 = 0 AND x.cl = 4 THEN 'reviewer-b' ELSE 'reviewer-a' END AS actor FROM norm n JOIN mj m ON m.document_id = n.document_id AND m.account = n.account AND m.period_label = n.period_label AND m.statement = n.statement"
    " JOIN xrev x ON x.document_id = m.document_id AND x.fact_id = m.fact_id WHERE n.value IS NOT NULL AND n.document_id % 12 <> 11", "norm", "mj", "xrev"))
def j37_facts(spark, sf):
    """The facts behind every cell with the decision on each."""
    f = FL.Filing(spark, sf)
    led, _ = MP.build_ledger(MP.normalise(f.mappings, f.reviewed))
    t = MP.trace_facts(f.mappings, f.reviewed, led)
    return as_double(t.select("company_id", "statement", "account", "year", "fact_id", "fact_page", "raw_label", "mapping_type", "contribution", "action", "actor"), "contribution")


_DIGITS = "CASE WHEN document_id % 3 = 1 THEN translate(format('{:,.2f}', CAST(abs(parsed) AS DOUBLE)), ',.', '.,') ELSE format('{:,.2f}', CAST(abs(parsed) AS DOUBLE)) END"
_RAW = f"CASE WHEN dashed THEN '—' ELSE CASE WHEN account = 'revenue' AND document_id % 3 <> 1 THEN '$' ELSE '' END || CASE WHEN parsed < 0 THEN '(' || {_DIGITS} || ')' ELSE {_DIGITS} END || CASE WHEN footnoted THEN '(2)' ELSE '' END END"


@register("e02_sources", sql(
    "SELECT s.s_suppkey AS company_id, s.s_name AS company_name, sha256(s.s_name) AS hash, COALESCE(g.pages, 0) AS pages, CAST(COALESCE(g.facts, 0) AS BIGINT) AS facts, CAST(COALESCE(g.verified, 0) AS BIGINT) AS verified,"
    f" CASE WHEN ({FL.SCALE_OK.replace('company_id', 's_suppkey')}) AND ({FL.CURRENCY_OK.replace('company_id', 's_suppkey')}) THEN 'confirmed' ELSE 'unconfirmed' END AS metadata, CASE WHEN g.facts = g.verified THEN 'verified' ELSE 'unverified' END AS status"
    " FROM supplier s LEFT JOIN (SELECT document_id, max(page) AS pages, count(*) AS facts, count(*) FILTER (WHERE done AND mapped) AS verified FROM xgate GROUP BY 1) g ON g.document_id = s.s_suppkey", "xgate"))
def e02(spark, sf):
    f = FL.Filing(spark, sf)
    return EX.sources(f.documents, RV.gates(f.reviewed, MP.fact_mapping_state(f.mappings), f.documents))


@register("e03_raw_facts", sql(
    f"SELECT x.document_id AS company_id, x.fact_id, x.page, x.raw_label AS label, {_RAW} AS raw, x.period_label AS period, {sd('x.parsed', 'value')}, CASE WHEN x.parsed IS NULL THEN '{EX.PARSER_REFUSED}' END AS missing, x.confidence,"
    " concat_ws(', ', CASE WHEN dashed THEN 'parsed' END, CASE WHEN footnoted THEN 'clean_numeric' END, CASE WHEN repeated THEN 'table_intact' END) AS evidence_lacking, x.status,"
    f" {_ACTION} AS decision, CASE WHEN (x.document_id + x.rw + x.cl) % 17 = 0 AND x.cl = 4 THEN 'second look' ELSE 'checked against the page' END AS reason FROM xrev x", "xrev"))
def e03(spark, sf):
    return as_double(EX.raw_facts(FL.Filing(spark, sf).reviewed).withColumn("confidence", F.col("confidence").cast("double")), "value")


@register("e04_mapping", sql(
    "SELECT document_id AS company_id, fact_id, raw_label AS label, account, mapping_type, sign, " + sd("allocation", "allocation") + ", CAST(version AS INTEGER) AS version, CASE WHEN document_id % 12 <> 11 THEN 'approved' ELSE '(not approved)' END AS approval FROM mj", "mj"))
def e04(spark, sf):
    f = FL.Filing(spark, sf)
    return as_double(EX.mapping(f.mappings, f.reviewed), "allocation")


@register("j39_revision_keep", sql(
    "SELECT document_id, fact_id, status, CASE WHEN status = 'accepted' AND dashed = FALSE AND document_id % 3 = 1 AND document_id % 20 <> 19 THEN 'unreviewed' ELSE status END AS status_after FROM xrev", "xrev"))
def j39(spark, sf):
    """A document confirmed as dot-decimal after all: comma figures no longer read, and their acceptances are withdrawn."""
    f = FL.Filing(spark, sf)
    revised = FL.documents(spark, sf).withColumn("locale", F.when(F.col("locale") == "comma_decimal", "dot_decimal").otherwise(F.col("locale")))
    after = FA.build_facts(FL.raw_cells(spark, sf), revised)
    return RV.revise(f.reviewed, after).select("document_id", "fact_id", "status", "status_after")
