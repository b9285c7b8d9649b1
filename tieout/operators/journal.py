"""Journal entry validation before upload.

``draft`` holds text columns as exported: row_id (file order), journal, line,
date, fund, org, object, account_description, debit, credit, line_description,
reference. ``parse_draft`` adds the parsed values once; all checks work on it.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions import scalars as s

# Rules that stop an upload, default settings, upload layout.
BLOCKING_RULES = (
    "no_duplicate_journal_line", "eff_date_required", "eff_date_valid", "eff_date_in_fiscal_period",
    "required_fields_present", "account_in_coa", "no_inactive_account", "no_both_debit_and_credit",
    "no_negative_amount", "debits_equal_credits_per_journal", "debits_equal_credits_overall")
FISCAL_START = dt.date(2025, 7, 1)
FISCAL_END = dt.date(2026, 6, 30)
ROUND_DOLLAR_FROM = Decimal("10000.00")
MIN_DESCRIPTION = 3
UPLOAD_HEADERS = ("Journal", "Line", "Eff Date", "Fund", "Org", "Object", "Account Description", "Debit", "Credit",
                  "Line Description", "Reference")

SUM_TYPE = "decimal(28,4)"
_TEXT = ("journal", "line", "fund", "org", "object", "account_description", "line_description", "reference")
_SEGMENTS = ("fund", "org", "object")


def parse_draft(draft: DataFrame) -> DataFrame:
    text = {c: s.text_key(c) if c in draft.columns else F.lit("") for c in (*_TEXT, "date", "debit", "credit")}
    return (draft.withColumns(text)
            .withColumns({"eff_date": s.parse_date("date"), "dr": s.parse_amount("debit"), "cr": s.parse_amount("credit")}))


def _nonzero(c: str) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(False))


def _row(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select("row_id", "journal", "line", *cols)


def je_duplicate_lines(parsed: DataFrame) -> DataFrame:
    """(journal, line) seen before: the later rows, each with the first one."""
    first = parsed.groupBy("journal", "line").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return parsed.join(first, ["journal", "line"]).where("row_id > first_row").select("row_id", "journal", "line", "first_row")


def je_date_required(parsed: DataFrame) -> DataFrame:
    return _row(parsed.where("date = ''"))


def je_date_valid(parsed: DataFrame) -> DataFrame:
    return _row(parsed.where("date <> '' and eff_date is null"), "date")


def je_date_in_period(parsed: DataFrame, start: dt.date = FISCAL_START, end: dt.date = FISCAL_END) -> DataFrame:
    return _row(parsed.where((F.col("eff_date") < F.lit(start)) | (F.col("eff_date") > F.lit(end))), "eff_date")


def je_required_fields(parsed: DataFrame) -> DataFrame:
    """Missing segments (listed together) and rows with neither debit nor credit."""
    absent = F.filter(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in _SEGMENTS]), lambda x: x.isNotNull())
    missing = parsed.withColumn("missing", F.array_join(absent, ", ")).where("missing <> ''")
    empty = parsed.where(~_nonzero("dr") & ~_nonzero("cr")).withColumn("missing", F.lit("debit or credit"))
    return _row(missing, "missing").unionByName(_row(empty, "missing"))


def je_both_sides(parsed: DataFrame) -> DataFrame:
    return _row(parsed.where(_nonzero("dr") & _nonzero("cr")), "dr", "cr")


def je_negative(parsed: DataFrame) -> DataFrame:
    """Negative debits and credits, one row per side."""
    sides = F.explode(F.array(F.struct(F.lit("debit").alias("side"), F.col("dr").alias("amount")),
                              F.struct(F.lit("credit").alias("side"), F.col("cr").alias("amount"))))
    low = (F.col("dr") < 0) | (F.col("cr") < 0)
    return _row(parsed.where(low).withColumn("_s", sides).select("*", "_s.side", "_s.amount").where("amount < 0"), "side", "amount")


def je_account_in_coa(parsed: DataFrame, chart: DataFrame) -> DataFrame:
    """Fund, org and object values the chart does not list, each on its own row."""
    def long(df: DataFrame, *keep: str) -> DataFrame:
        segs = F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), s.text_key(c).alias("value")) for c in _SEGMENTS]))
        return df.select(*keep, segs.alias("_s")).select(*keep, "_s.segment", "_s.value").where("value <> ''")

    known = long(chart).distinct()
    return long(parsed, "row_id", "journal", "line").join(known, ["segment", "value"], "left_anti").select(
        "row_id", "journal", "line", "segment", "value")


def _combos(df: DataFrame, *extra: Column) -> DataFrame:
    return (df.select(*[s.text_key(c).alias(c) for c in _SEGMENTS], *extra)
            .where("fund <> '' and org <> '' and object <> ''"))


def je_inactive_account(parsed: DataFrame, chart: DataFrame) -> DataFrame:
    """Rows on a fund-org-object combination whose status is neither active nor blank."""
    listed = _combos(chart, F.lower(s.text_key("status")).alias("status"), F.col("row_id").alias("_o"))
    status = listed.groupBy(*_SEGMENTS).agg(F.max_by("status", "_o").alias("status")).where("status not in ('active', '')")
    return parsed.join(status, list(_SEGMENTS)).select("row_id", "journal", "line", *_SEGMENTS, "status")


def je_combo_unseen(parsed: DataFrame, chart: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Every segment known, but the combination in neither chart nor ledger history."""
    rows = parsed.where("fund <> '' and org <> '' and object <> ''")
    for c in _SEGMENTS:
        rows = rows.join(chart.select(s.text_key(c).alias(c)).where(F.col(c) != "").distinct(), c, "left_semi")
    seen = _combos(chart)
    if history is not None:
        seen = seen.unionByName(_combos(history))
    return rows.join(seen.distinct(), list(_SEGMENTS), "left_anti").select("row_id", "journal", "line", *_SEGMENTS)


def je_short_description(parsed: DataFrame, minimum: int = MIN_DESCRIPTION) -> DataFrame:
    return _row(parsed.where(F.length("line_description") < minimum), "line_description")


def je_round_dollar(parsed: DataFrame, minimum=ROUND_DOLLAR_FROM) -> DataFrame:
    zero = F.lit(0).cast(s.QTY)
    amount = (F.coalesce("dr", zero) + F.coalesce("cr", zero)).cast(s.QTY)
    # made a row of its own, the amount is worked out once; a filter on a plain column repeats the parsing for every mention of it
    once = _row(parsed, F.explode(F.array(amount)).alias("amount"))
    return once.where((F.col("amount") >= F.lit(minimum)) & (F.col("amount") % 1 == 0))


def _sides(parsed: DataFrame, *keys: str) -> DataFrame:
    zero = F.lit(0)
    return parsed.groupBy(*keys).agg(F.coalesce(F.sum("dr"), zero).cast(SUM_TYPE).alias("debits"),
                                     F.coalesce(F.sum("cr"), zero).cast(SUM_TYPE).alias("credits"))


def _unequal() -> Column:
    return F.bround("debits", 2) != F.bround("credits", 2)


def je_balance_per_journal(parsed: DataFrame) -> DataFrame:
    return _sides(parsed, "journal").where(_unequal()).withColumn(
        "difference", (F.col("debits") - F.col("credits")).cast(SUM_TYPE))


def je_balance_overall(parsed: DataFrame) -> DataFrame:
    return _sides(parsed).withColumn("balanced", ~_unequal())


def _row_rules(parsed: DataFrame, start: dt.date, end: dt.date, more: list[tuple[Column, str, str]]) -> DataFrame:
    """The rules that need nothing but the row itself, and ``more`` of its flags, in one scan."""
    zero = F.lit(0).cast(s.QTY)
    amount = F.coalesce("dr", zero) + F.coalesce("cr", zero)
    tests = [
        (F.col("date") == "", "eff_date_required", "high"),
        ((F.col("date") != "") & F.col("eff_date").isNull(), "eff_date_valid", "high"),
        ((F.col("eff_date") < F.lit(start)) | (F.col("eff_date") > F.lit(end)), "eff_date_in_fiscal_period", "high"),
        (F.least(*[F.length(c) for c in _SEGMENTS]) == 0, "required_fields_present", "high"),
        (~_nonzero("dr") & ~_nonzero("cr"), "required_fields_present", "high"),
        (_nonzero("dr") & _nonzero("cr"), "no_both_debit_and_credit", "high"),
        (F.col("dr") < 0, "no_negative_amount", "high"), (F.col("cr") < 0, "no_negative_amount", "high"),
        (F.length("line_description") < MIN_DESCRIPTION, "short_description", "low"),
        ((amount >= F.lit(ROUND_DOLLAR_FROM)) & (amount % 1 == 0), "round_dollar_amount", "low"), *more]
    fired = F.array(*[F.when(t, F.struct(F.lit(n).alias("rule_used"), F.lit(v).alias("severity"))) for t, n, v in tests])
    return parsed.select("row_id", "journal", F.explode(fired).alias("_f")).where("_f is not null").select(
        "_f.rule_used", "_f.severity", F.col("row_id").cast("string").alias("row_id"), "journal")


def _accounts(df: DataFrame, *extra: Column) -> DataFrame:
    """Each segment of a row and its whole combination as (kind, value); blank ones left out."""
    segs = [s.text_key(c) for c in _SEGMENTS]
    whole = F.when(F.array_min(F.array(*[F.length(c) for c in segs])) > 0, F.to_json(F.array(*segs))).otherwise("")
    kinds = [F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in zip([*_SEGMENTS, "combo"], [*segs, whole])]
    return df.select(F.explode(F.array(*kinds)).alias("_k"), *extra).select("_k.kind", "_k.value", *extra).where("value <> ''")


def account_flags(parsed: DataFrame, chart: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Per distinct (fund, org, object) of the draft: n_unknown segments, whether the
    combination is inactive, and whether it is unseen though every segment is known.

    Chart and history are read once and fold to distinct accounts; the draft meets
    them by its distinct combinations, not by its rows.
    """
    listed = _accounts(chart.select(*_SEGMENTS, F.lower(s.text_key("status")).alias("status"), F.col("row_id").alias("_o")), F.col("status"), F.col("_o"))
    if history is not None:
        old = _accounts(history).where("kind = 'combo'").select("kind", "value", F.lit(None).cast("string").alias("status"), F.lit(None).alias("_o"))
        listed = listed.unionByName(old)
    known = listed.groupBy("kind", "value").agg(F.max_by("status", "_o").alias("status"))
    drafted = parsed.select(*_SEGMENTS).distinct().select(*[F.col(c).alias(f"_{c}") for c in _SEGMENTS], *_SEGMENTS)
    met = (_accounts(drafted, *[F.col(f"_{c}") for c in _SEGMENTS])
           .join(known.withColumn("_known", F.lit(True)), ["kind", "value"], "left"))
    combo, lacks = F.col("kind") == "combo", F.col("_known").isNull()
    flags = met.groupBy(*[F.col(f"_{c}").alias(c) for c in _SEGMENTS]).agg(
        F.count_if(lacks & ~combo).alias("n_unknown"),
        F.coalesce(F.max(combo & ~F.col("status").isin("active", "")), F.lit(False)).alias("inactive"),
        F.max(combo & lacks).alias("_unseen"))
    return flags.select(*_SEGMENTS, "n_unknown", "inactive", (F.col("_unseen") & (F.col("n_unknown") == 0)).alias("unseen"))


def je_findings(parsed: DataFrame, chart: DataFrame, history: DataFrame | None = None,
                start: dt.date = FISCAL_START, end: dt.date = FISCAL_END) -> DataFrame:
    """All rules as (rule_used, severity, row_id, journal); balance rules have no row.

    Row, duplicate and account rules are flags of one frame: the draft joined with
    its (journal, line) keys that repeat and with ``account_flags``.
    """
    again = parsed.groupBy("journal", "line").agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    frame = (parsed.join(again, ["journal", "line"], "left")
             .join(account_flags(parsed, chart, history), list(_SEGMENTS), "left"))
    more = [(F.col("row_id") > F.col("_first"), "no_duplicate_journal_line", "high"),
            *[(F.col("n_unknown") > i, "account_in_coa", "high") for i in range(len(_SEGMENTS))],
            (F.col("inactive"), "no_inactive_account", "high"), (F.col("unseen"), "account_combination_unseen", "medium")]
    out = _row_rules(frame, start, end, more)

    per_journal = _sides(parsed, "journal")
    overall = per_journal.agg(F.coalesce(F.sum("debits"), F.lit(0)).cast(SUM_TYPE).alias("debits"),
                              F.coalesce(F.sum("credits"), F.lit(0)).cast(SUM_TYPE).alias("credits"))
    none = F.lit(None).cast("string")
    for df, name, journal in ((per_journal, "debits_equal_credits_per_journal", F.col("journal")), (overall, "debits_equal_credits_overall", none)):
        out = out.unionByName(df.where(_unequal()).select(F.lit(name).alias("rule_used"), F.lit("critical").alias("severity"),
                                                          none.alias("row_id"), journal.alias("journal")))
    return out


def je_blocking_split(findings: DataFrame) -> DataFrame:
    """One row: blocking and warning counts, and whether the draft may be uploaded."""
    blocking = F.col("rule_used").isin(*BLOCKING_RULES)
    return findings.agg(F.count_if(blocking).alias("blocking_count"), F.count_if(~blocking).alias("warning_count")).withColumn(
        "upload_ready", F.col("blocking_count") == 0)


def journal_upload_rows(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """Upload layout in file order with its source row, empty while any blocking
    rule fires."""
    gate = je_blocking_split(findings).where("upload_ready").select("upload_ready")
    money = lambda c: F.when(_nonzero(c), F.bround(c, 2).cast(s.MONEY).cast("string")).otherwise("")
    cols = ["journal", "line", F.coalesce(F.col("eff_date").cast("string"), F.lit("")), "fund", "org", "object",
            "account_description", money("dr"), money("cr"), "line_description", "reference"]
    named = [(F.col(c) if isinstance(c, str) else c).alias(h) for c, h in zip(cols, UPLOAD_HEADERS)]
    return parsed.join(gate, F.lit(True) == F.col("upload_ready")).select(
        F.col("row_id").alias("source_row"), *named)
