"""Rules that read labels, headers and captions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dims

EXACT, STRONG, WEAK = 95, 85, 60

# Labels that must not be mapped, and why.
BLOCKED = (
    (r"(?i)^total\s+current\s+(assets|liabilities)\b", "no current-total line in the chart"),
    (r"(?i)^total\s+(non-?current|long-?term)\s+(assets|liabilities)\b", "no non-current-total line in the chart"),
    (r"(?i)^total\s+liabilities\s+and\s+(stockholders'?|shareholders'?)?\s*equity\b", "balance-sheet footing, not total liabilities"),
    (r"(?i)cash\s+(and\s+cash\s+equivalents\s+)?at\s+(the\s+)?(beginning|end)\b", "roll-forward output, not an input"),
    (r"(?i)\bper\s+share\b|\bearnings\s+per\s+share\b|\bweighted[- ]average\s+(number\s+of\s+)?shares\b", "per-share figure or share count"),
    (r"(?i)^(supplemental|non-?cash)\s+(disclosure|information|investing)", "outside the three statements"),
)

# Account, pattern, score in hundredths.
RULES = (
    ("selling_general_administrative", r"^(selling,?\s+general\s+and\s+administrative|general\s+and\s+administrative|sg&a)", EXACT),
    ("selling_general_administrative", r"^(selling|distribution|administrative)\s+(and\s+\w+\s+)?(expenses?|costs?)$", STRONG),
    ("research_development", r"^research\s+and\s+development|^r&d\b", EXACT),
    ("other_operating_expenses", r"^(restructuring|impairment\s+of\s+(goodwill|intangibles?|assets))", STRONG),
    ("ebitda", r"^ebitda$", EXACT),
    ("interest_income", r"^(interest|investment)\s+income$", EXACT),
    ("interest_income", r"^interest\s+and\s+(other\s+)?(investment\s+)?income", STRONG),
    ("net_income_to_parent", r"attributable\s+to\s+.{0,40}\b(parent|company|owners|shareholders|stockholders)\b", STRONG),
    ("net_income_to_minority", r"attributable\s+to\s+.{0,40}\b(non-?controlling|minority)\b", STRONG),
    ("goodwill", r"^goodwill$", EXACT),
    ("goodwill", r"^goodwill\s+and\s+(other\s+)?intangible", WEAK),
    ("intangibles", r"^(other\s+)?intangible\s+assets", EXACT),
    ("intangibles", r"^(capitali[sz]ed\s+software|developed\s+technology|customer\s+relationships)", STRONG),
    ("lease_liabilities", r"^(operating\s+|finance\s+)?lease\s+liabilit(y|ies)", EXACT),
    ("lease_liabilities", r"^(current\s+|non-?current\s+)?(portion\s+of\s+)?(operating\s+|finance\s+)?lease", STRONG),
    ("minority_interest", r"^(non-?controlling|minority)\s+interests?", EXACT),
    ("depreciation", r"^depreciation$", EXACT),
    ("amortization", r"^amorti[sz]ation(\s+of\s+(intangibles?|intangible\s+assets))?$", EXACT),
    ("disposals", r"^(proceeds\s+from\s+)?(sale|disposal)s?\s+of\s+(business|subsidiar|propert|equipment|assets)", STRONG),
    ("share_issuance", r"^(proceeds\s+from\s+)?(issuance\s+of\s+(common\s+)?(stock|shares)|exercise\s+of\s+(stock\s+)?options)", STRONG),
    ("fx_effect_on_cash", r"effect\s+of\s+(foreign\s+)?(exchange|currency)\s+rate", EXACT),
    ("net_change_in_cash", r"^(net\s+)?(increase|decrease|change)\s+in\s+cash", EXACT),
    ("revenue", r"^(net\s+)?(sales|revenues?)$", EXACT),
    ("revenue", r"revenue\s+from\s+contracts\s+with\s+customers", EXACT),
    ("revenue", r"^(total\s+)?(net\s+)?(sales|revenues?)\b", STRONG),
    ("revenue", r"\bturnover\b", STRONG),
    ("cogs", r"^cost\s+of\s+(goods\s+sold|sales|revenue|services)", EXACT),
    ("cogs", r"\bcost\s+of\s+(goods|sales|revenue)\b", STRONG),
    ("gross_profit", r"^gross\s+(profit|margin|income)$", EXACT),
    ("operating_expenses", r"^(selling,?\s+general\s+and\s+administrative|sg&a)", EXACT),
    ("operating_expenses", r"^research\s+and\s+development", EXACT),
    ("operating_expenses", r"^(total\s+)?operating\s+(expenses|costs)", EXACT),
    ("operating_expenses", r"\b(restructuring|impairment|amortisation\s+of\s+acquired)", STRONG),
    ("operating_expenses", r"\b(marketing|distribution|administrative)\s+(expense|cost)", STRONG),
    ("ebit", r"^(operating\s+(income|profit)|income\s+from\s+operations)$", EXACT),
    ("interest_expense", r"^interest\s+expense", EXACT),
    ("interest_expense", r"^(finance|financing)\s+costs?$", STRONG),
    ("other_income_expense", r"^(other|non-?operating)\s+(income|expense)", EXACT),
    ("other_income_expense", r"^interest\s+income", STRONG),
    ("other_income_expense", r"\b(foreign\s+(exchange|currency)|equity\s+in\s+earnings|gain\s+on\s+(sale|disposal))", STRONG),
    ("pretax_income", r"income\s+before\s+(income\s+)?tax", EXACT),
    ("pretax_income", r"^(profit|earnings)\s+before\s+tax", EXACT),
    ("taxes", r"^(income|corporate)\s+tax(es|ation)?\s+(expense|provision|charge)", EXACT),
    ("taxes", r"^provision\s+for\s+income\s+tax", EXACT),
    ("taxes", r"^(income\s+)?tax(es)?$", WEAK),
    ("net_income", r"^net\s+(income|earnings|profit)", EXACT),
    ("net_income", r"^(profit|loss)\s+for\s+the\s+(year|period)", EXACT),
    ("cash", r"^cash\s+and\s+cash\s+equivalents", EXACT),
    ("cash", r"^cash$", STRONG),
    ("accounts_receivable", r"^(accounts|trade)\s+receivable", EXACT),
    ("accounts_receivable", r"^receivables", STRONG),
    ("inventory", r"^inventor(y|ies)", EXACT),
    ("inventory", r"^stock$", WEAK),
    ("other_current_assets", r"^other\s+current\s+assets", EXACT),
    ("other_current_assets", r"^(other|prepaid|prepayments)", STRONG),
    ("other_current_assets", r"\b(short-?term\s+investments|restricted\s+cash|contract\s+assets)", STRONG),
    ("ppe_net", r"^property,?\s+(plant\s+and\s+)?equipment", EXACT),
    ("ppe_net", r"^(fixed|tangible)\s+assets", STRONG),
    ("other_noncurrent_assets", r"^other\s+(non-?current|long-?term)\s+assets", EXACT),
    ("other_noncurrent_assets", r"^(goodwill|intangible)", STRONG),
    ("other_noncurrent_assets", r"\b(right-?of-?use|deferred\s+tax\s+assets?|equity[- ]method\s+investments?)", STRONG),
    ("total_assets", r"^total\s+assets$", EXACT),
    ("accounts_payable", r"^(accounts|trade)\s+payable", EXACT),
    ("other_current_liabilities", r"^other\s+current\s+liabilit", EXACT),
    ("other_current_liabilities", r"^(accrued|deferred\s+revenue|contract\s+liabilit)", STRONG),
    ("debt", r"^(long-?term\s+)?(debt|borrowings|loans)", EXACT),
    ("debt", r"\b(notes\s+payable|current\s+portion\s+of\s+long-?term\s+debt|finance\s+lease\s+liabilit|lease\s+liabilit)", STRONG),
    ("other_noncurrent_liabilities", r"^other\s+(non-?current|long-?term)\s+liabilit", EXACT),
    ("other_noncurrent_liabilities", r"\b(deferred\s+tax\s+liabilit|pension|post-?retirement|provisions)", STRONG),
    ("total_liabilities", r"^total\s+liabilities$", EXACT),
    ("common_equity", r"^(common|ordinary)\s+stock|^share\s+capital|^additional\s+paid-?in\s+capital|^treasury\s+stock|accumulated\s+other\s+comprehensive", EXACT),
    ("retained_earnings", r"^(retained\s+earnings|accumulated\s+(deficit|profits))", EXACT),
    ("total_equity", r"^total\s+(stockholders'?|shareholders'?|owners'?)?\s*equity$", EXACT),
    ("depreciation_amortization", r"^depreciation", EXACT),
    ("depreciation_amortization", r"^amorti[sz]ation", STRONG),
    ("stock_based_compensation", r"(stock|share)-?based\s+(compensation|payment)", EXACT),
    ("change_in_nwc", r"changes?\s+in\s+(operating\s+)?(working\s+capital|assets\s+and\s+liabilities)", EXACT),
    ("cash_flow_from_operations", r"^(net\s+)?cash\s+(provided\s+by|from|used\s+in)\s+operating", EXACT),
    ("capex", r"(purchases?|acquisitions?|additions?)\s+of\s+(property|plant|equipment|fixed\s+assets)", EXACT),
    ("capex", r"^capital\s+expenditures?", EXACT),
    ("acquisitions", r"acquisitions?\s+(of\s+)?(business|subsidiar)|business\s+combinations?", EXACT),
    ("cash_flow_from_investing", r"^(net\s+)?cash\s+(provided\s+by|from|used\s+in)\s+investing", EXACT),
    ("debt_issuance", r"^proceeds\s+from\s+(the\s+)?(issuance\s+of\s+)?(debt|borrowings|notes|long-?term)", EXACT),
    ("debt_repayment", r"(repayments?|payments?)\s+(of|on)\s+(debt|borrowings|notes|long-?term)", EXACT),
    ("share_repurchases", r"(repurchases?|buy-?backs?)\s+of\s+(common\s+)?(stock|shares)", EXACT),
    ("dividends", r"^dividends?\s+(paid|to)", EXACT),
    ("dividends", r"^dividends?$", STRONG),
    ("cash_flow_from_financing", r"^(net\s+)?cash\s+(provided\s+by|from|used\s+in)\s+financing", EXACT),
)

# Caption patterns, first match wins.
STATEMENT_CAPTIONS = (
    ("income", r"(?i)statements?\s+of\s+(operations|income|profit)|income\s+statement|profit\s+and\s+loss|gewinn|verlustrechnung"),
    ("balance", r"(?i)balance\s+sheets?|financial\s+position|bilanz"),
    ("cashflow", r"(?i)cash\s+flows?|kapitalfluss"),
)
SCOPE_CAPTIONS = (
    ("consolidated", r"(?i)\bconsolidated\b|\bkonzern"),
    ("segment", r"(?i)\bsegment\b|\bby\s+segment\b"),
    ("parent", r"(?i)\bparent\s+company\b|\bcompany\s+only\b|\bstandalone\b"),
)

# Header patterns.
OTHER_BASIS = r"(?i)\b(?:Q[1-4]|quarter|three\s+months|six\s+months|nine\s+months|YTD|TTM|LTM|interim)\b"
ANY_YEAR = r"((?:19|20)\d{2})"
PERIOD_SHAPE = r"[A-Za-z]|(?:19|20)\d{2}"  # what every period has somewhere
QUALIFIED_YEAR = r"^(?:FY\s*)?(?:19|20)\d{2}\s*(?:[(\[*†‡].*)$"
BARE_YEAR = r"(?i)^(?:FY\s*)?((?:19|20)\d{2})\s*(?:[AE])?$"
TRAILING_YEAR = r"((?:19|20)\d{2})\s*$"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def first_match(c: Column, patterns) -> Column:
    out = None
    for name, pattern in patterns:
        cond = F.coalesce(c, F.lit("")).rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def statement_of_caption(c: Column) -> Column:
    return first_match(c, STATEMENT_CAPTIONS)


def scope_of_caption(c: Column) -> Column:
    return F.coalesce(first_match(c, SCOPE_CAPTIONS), F.lit("undetermined"))


def period_label(c: Column) -> Column:
    """Struct of the period a header names and whether it is ambiguous; NULL label means no period."""
    v = squeeze(c)
    years = F.array_distinct(F.regexp_extract_all(v, F.lit(ANY_YEAR), 1))
    verbatim = (v != "") & (v.rlike(OTHER_BASIS) | (F.size(years) > 1) | v.rlike(QUALIFIED_YEAR))
    bare = F.nullif(F.regexp_extract(v, BARE_YEAR, 1), F.lit(""))
    dated = F.when(F.length(v) <= 40, F.nullif(F.regexp_extract(v, TRAILING_YEAR, 1), F.lit("")))
    period = F.struct(F.when(verbatim, v).otherwise(F.coalesce(bare, dated)).alias("label"), verbatim.alias("ambiguous"))
    return F.when(c.rlike(PERIOD_SHAPE), period).otherwise(F.struct(F.lit(None).cast("string").alias("label"), F.lit(False).alias("ambiguous")))


def blocked_reason(label: Column) -> Column:
    return first_match(squeeze(label), [(reason, p) for p, reason in BLOCKED])


_SIGN = {row[0]: row[2] for row in dims.CHART}
_STATEMENTS = {row[0]: row[1] for row in dims.CHART}


def infer_sign(code: Column, value: Column) -> Column:
    """Whether the printed sign contradicts the chart's; zero or absent never flips."""
    pos = [a for a, s in _SIGN.items() if s == "positive"]
    neg = [a for a, s in _SIGN.items() if s == "negative"]
    flip = (code.isin(pos) & (value < 0)) | (code.isin(neg) & (value > 0))
    return F.when(F.coalesce(flip, F.lit(False)), "negated").otherwise("as_printed")


def candidates(label: Column, statement: Column, limit: int = 3) -> Column:
    """Ranked accounts a label may be: best score per account, then score, then name.

    Patterns are literals, so each compiles once per task. Ninety tests a label are dear: apply it to distinct labels (`mapping.propose`).
    """
    clean = label  # already squeezed by the caller
    by_code: dict[str, list[tuple[str, int]]] = {}
    for code, pattern, score in RULES:
        by_code.setdefault(code, []).append((pattern, score))
    entries = []
    for code, rules in by_code.items():
        best = None
        for pattern, score in sorted(rules, key=lambda r: -r[1]):
            cond = clean.rlike("(?i)" + pattern)
            best = F.when(cond, F.lit(score)) if best is None else best.when(cond, F.lit(score))
        allowed = statement.isNull() | statement.isin(*_STATEMENTS[code])
        entries.append(F.struct((-F.when(allowed, best)).alias("rank"), F.lit(code).alias("account")))
    hits = F.array_sort(F.filter(F.array(*entries), lambda e: e["rank"].isNotNull()))
    ranked = F.transform(F.slice(hits, 1, limit), lambda e: F.struct(e["account"].alias("account"), (-e["rank"]).alias("score")))
    return F.when(first_match(clean, [(r, p) for p, r in BLOCKED]).isNull() & (clean != ""), ranked).otherwise(F.array().cast("array<struct<account:string,score:int>>"))
