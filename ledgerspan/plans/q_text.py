"""Registered queries over texts and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as TX
from ..operators import audit as AU
from ..sources import derived as D
from .duck import q, sql, values
from .registry import register

W = r"[\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """The pattern for an engine whose \\w knows ASCII only."""
    return pattern.replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"[\w.-]", r"[\p{L}\p{N}_.-]")


def _redact_sql(c: str) -> str:
    for p, r in TX.REDACTIONS:
        c = f"regexp_replace({c}, {q(re2(p))}, {q(r.replace('$1', chr(92) + '1'))}, 'g')"
    return c


@register("p31_redact_text", f"SELECT doc_id, md5(redacted) AS digest, redacted <> text AS changed, CAST(len(regexp_extract_all(redacted, '\\[redacted')) AS INTEGER) AS marks FROM (SELECT doc_id, text, {_redact_sql('text')} AS redacted FROM documents)")
def p31(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text").select("doc_id", "text", TX.redact(F.col("text")).alias("redacted"))
    return d.select("doc_id", F.md5("redacted").alias("digest"), (F.col("redacted") != F.col("text")).alias("changed"), F.size(F.regexp_extract_all("redacted", F.lit(r"(\[redacted)"), 1)).alias("marks"))


@register("p32_scan_secret_shapes", "SELECT doc_id, finding FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(n)}" for n, p in TX.SECRETS) + " END AS finding FROM documents) WHERE finding IS NOT NULL")
def p32(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.secret_shape(F.col("text")).alias("finding")).where("finding IS NOT NULL")


@register("p21_detect_locale", "SELECT doc_id, CAST(dot AS BIGINT) AS dot_numbers, CAST(comma AS BIGINT) AS comma_numbers, CASE WHEN dot > 0 AND comma = 0 THEN 'dot_decimal' WHEN comma > 0 AND dot = 0 THEN 'comma_decimal' END AS number_locale FROM ("
          f"SELECT doc_id, len(regexp_extract_all(text, {q(TX.ONLY_DOT)})) AS dot, len(regexp_extract_all(text, {q(TX.ONLY_COMMA)})) AS comma FROM documents)")
def p21(spark, sf):
    pages = D.table(spark, sf, "documents").selectExpr("doc_id AS document_id", "1 AS page", "text")
    return TX.detect_metadata(pages).select(F.col("document_id").alias("doc_id"), "dot_numbers", "comma_numbers", "number_locale")


_COVER = ("'Form 10-K. Amounts in ' || CASE l_linenumber % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' ELSE 'units' END || ' of ' || CASE l_linenumber % 4 WHEN 0 THEN 'U.S. dollars' WHEN 1 THEN 'euros' WHEN 2 THEN 'pounds sterling' ELSE 'crowns' END"
          " || ', for the fiscal year ended ' || CASE WHEN l_linenumber % 2 = 0 THEN 'December 31, ' ELSE '29 Feb ' END || CAST(year(l_shipdate) AS {s}) || CASE l_returnflag WHEN 'R' THEN '. These statements have been audited under US GAAP.' WHEN 'A' THEN '. Unaudited, IFRS.' ELSE '.' END")


@register("p20_detect_metadata", sql(
    "SELECT document_id, " + ", ".join(f"arg_min({c}, page) FILTER (WHERE {c} IS NOT NULL AND page <= 4) AS {c}" for c in ("displayed_scale", "reporting_currency"))
    + ", CASE WHEN count(*) FILTER (WHERE page <= 4 AND l_returnflag = 'R') > 0 THEN 'audited' WHEN count(*) FILTER (WHERE page <= 4 AND l_returnflag = 'A') > 0 THEN 'unaudited' END AS audited_status,"
    " CASE WHEN count(*) FILTER (WHERE page <= 4 AND l_returnflag = 'R') > 0 THEN 'US_GAAP' WHEN count(*) FILTER (WHERE page <= 4 AND l_returnflag = 'A') > 0 THEN 'IFRS' END AS accounting_standard,"
    " CAST(arg_min(pe, page) FILTER (WHERE pe IS NOT NULL AND page <= 4) AS VARCHAR) AS reporting_period_end FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' END AS displayed_scale, CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS reporting_currency,"
    " CASE WHEN l_linenumber % 2 = 0 THEN make_date(y, 12, 31) WHEN y % 4 = 0 THEN make_date(y, 2, 29) END AS pe FROM (SELECT l_orderkey AS document_id, l_linenumber, l_returnflag, year(l_shipdate) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page FROM lineitem)) GROUP BY document_id"))
def p20(spark, sf):
    """Each line item as a page of its order's filing."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pages = D.table(spark, sf, "lineitem").withColumn("page", F.row_number().over(w)).selectExpr("l_orderkey AS document_id", "page", _COVER.replace("{s}", "STRING") + " AS text")
    return TX.detect_metadata(pages).select("document_id", "displayed_scale", "reporting_currency", "audited_status", "accounting_standard", F.col("reporting_period_end").cast("string").alias("reporting_period_end"))


_EV = "SELECT event_id, ts AS at_ts, 'user-' || user_id AS actor, event_type AS action, 'entity-' || json_extract_string(props, '$.k') AS entity_id, CASE WHEN value > 50 THEN 'fact' ELSE 'document' END AS entity_type, value FROM events"


@register("p30_audit_filter", f"SELECT event_id, actor, action, entity_id FROM ({_EV}) WHERE action = 'error' AND entity_type = 'fact' AND at_ts >= TIMESTAMP '2024-01-05' AND contains(entity_id, '7')")
def p30(spark, sf):
    e = AU.filter_events(D.audit_events(spark, sf), action="error", entity_type="fact", since="2024-01-05", text="7")
    return AU.newest_first(e).select("event_id", "actor", "action", "entity_id")


@register("a10_audit_summary", f"SELECT actor, action, CAST(count(*) AS BIGINT) AS events, max(at_ts) AS latest FROM ({_EV}) GROUP BY 1, 2")
def a10(spark, sf):
    return AU.summary(D.audit_events(spark, sf))


@register("a11_filter_choices", f"SELECT DISTINCT 'actor' AS field, actor AS value FROM ({_EV}) UNION ALL SELECT DISTINCT 'action', action FROM ({_EV}) UNION ALL SELECT DISTINCT 'entity_type', entity_type FROM ({_EV})")
def a11(spark, sf):
    return AU.choices(D.audit_events(spark, sf))


@register("t04_newest_first", f"SELECT event_id, at_ts, actor FROM ({_EV})")
def t04(spark, sf):
    return AU.newest_first(D.audit_events(spark, sf)).select("event_id", F.col("at").alias("at_ts"), "actor")


@register("t06_report_row_limit", f"SELECT actor, event_id, CAST(position AS INTEGER) AS position, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY at_ts, event_id) AS position, count(*) OVER (PARTITION BY actor) AS total FROM ({_EV})) WHERE position <= 24")
def t06(spark, sf):
    return AU.report_rows(D.audit_events(spark, sf), ["actor"], [F.col("at"), F.col("event_id")]).select("actor", "event_id", "position", "total")


_STATES = dict(zip(("signup", "view", "click", "purchase", "error"), dims.STATUSES))
_ST = "CASE action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END"
_EDGES = values(dims.ASSUMPTION_EDGES, "previous, state", "ed")


@register("w15_transition_legality", f"SELECT entity_id, event_id, previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY at_ts, event_id) AS previous FROM (SELECT *, {_ST} AS state FROM ({_EV}))) s WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_EDGES}) e WHERE e.previous = s.previous AND e.state = s.state)")
def w15(spark, sf):
    e = D.audit_events(spark, sf).selectExpr("entity_id", "event_id", "at", f"{_ST} AS state")
    return AU.illegal_transitions(e, dims.ASSUMPTION_EDGES, F.to_date("at")).select("entity_id", "event_id", "previous", "state")


@register("w18_rate_burst", "SELECT event_id, CAST(n AS BIGINT) AS in_window, n > 5 AS over_limit FROM (SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND epoch_us(b.ts) > epoch_us(a.ts) - 86400000000 GROUP BY a.event_id)")
def w18(spark, sf):
    return AU.rate_burst(D.audit_events(spark, sf), "actor", 86400, 5).select("event_id", "in_window", "over_limit")
