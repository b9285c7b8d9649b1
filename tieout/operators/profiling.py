"""What an exported table looks like before any check runs on it.

Every profile is one aggregation over the table (columns become expressions,
not rows), so a wide table costs one scan and no shuffle of its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s

# Labels of total and footer lines.
TOTAL_LABEL = (r"(?i)\b(?:total|subtotal|grand\s*total|sum|totals)\b"
               r"|end\s+of\s+report|report\s+generated\s*:|program\s+id\s*:|\brecords\s+printed\b")

# Each label of TOTAL_LABEL holds one of these.
_LABEL_WORDS = ("total", "sum", "report", "program", "records")

# Header words that indicate each kind of column.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "date": ("date", "txn_date", "transaction_date", "posted_date", "post_date", "entry_date", "value_date",
             "effective_date", "posting_date", "gl_date", "trans_date", "jrnl_date", "jnl_date", "je_date", "eff_date",
             "check_date", "transaction_post_date"),
    "amount": ("amount", "value", "txn_amount", "transaction_amount", "debit", "credit", "balance", "total", "actual",
               "amount_usd", "net_amount", "amt", "reported_amount", "check_amount", "transaction_total",
               "budget_amount", "actual_amount", "expended"),
    "description": ("description", "memo", "payee", "vendor", "details", "narrative", "particulars", "name", "reference",
                    "line_description", "je_description", "comment", "account_label"),
    "account_code": ("account_code", "account_number", "account_no", "acct", "acct_code", "gl_code", "gl_account", "code",
                     "account"),
    "account_name": ("account_name", "account_title", "account_description", "gl_name", "line_item", "acct_desc",
                     "account_desc"),
    "section": ("section", "category", "group", "report_section", "heading", "statement_section"),
    "line_type": ("line_type", "type", "row_type", "level", "indent"),
    "fund": ("fund", "fund_code", "fund_name", "fund_no"),
    "department": ("department", "dept", "dept_code", "division", "unit", "department_name", "cost_center", "org",
                   "org_code"),
    "object": ("object", "object_code", "obj", "obj_code", "expenditure_object", "object_class"),
}

# Confidence limits.
AUTO_CONFIDENCE = 0.85
AMBIGUOUS_FROM = 0.4
PARSE_CONFIDENCE = 0.8


def text_columns(df: DataFrame, skip: tuple[str, ...] = ("row_id",)) -> list[str]:
    return [c for c in df.columns if c not in skip]


def parse_confidence(df: DataFrame, columns: list[str] | None = None, input_key: str = "input") -> DataFrame:
    """Per column the share of non-blank cells that read as a date / an amount
    (0 for a blank column)."""
    cols = columns or text_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        text = F.col(c).cast("string")
        aggs += [F.count_if(~s.is_blank(text)).alias(f"n{i}"),
                 F.count_if(s.parse_date(text).isNotNull()).alias(f"d{i}"),
                 F.count_if(s.is_amount(text)).alias(f"a{i}")]
    rows = F.explode(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("non_blank"),
        F.coalesce(F.try_divide(f"d{i}", f"n{i}"), F.lit(0.0)).alias("date_confidence"),
        F.coalesce(F.try_divide(f"a{i}", f"n{i}"), F.lit(0.0)).alias("amount_confidence")) for i, c in enumerate(cols)]))
    return df.agg(*aggs).select(rows.alias("_r")).select(F.lit(input_key).alias("input_key"), "_r.*")


def is_repeated_header(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Every cell says its own column's name (checked left to right)."""
    cols = columns or text_columns(df)
    # Letters and digits of the first cell settle nearly every row.
    likely = F.lower(F.regexp_replace(F.col(cols[0]).cast("string"), "[^A-Za-z0-9]", "")) == s.snake_case(cols[0]).replace("_", "")
    same = [s.snake_case_col(F.col(c).cast("string")) == s.snake_case(c) for c in cols]
    return F.coalesce(reduce(lambda a, b: a & b, [likely, *same]), F.lit(False))


def is_footer_total(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A total or footer label in any cell, or at most one filled cell and it is an amount."""
    cols = columns or text_columns(df)

    def test(row: Column) -> Column:
        cells = [row[f"c{i}"] for i in range(len(cols))]
        # One pattern over the row; the separator is neither word nor space, so a
        # label cannot span two cells. Every label holds one of a few words.
        text = F.concat_ws("\u0001", *cells)
        low = F.lower(text)
        label = reduce(lambda a, b: a | b, [low.contains(w) for w in _LABEL_WORDS]) & text.rlike(TOTAL_LABEL)
        blanks = reduce(lambda a, b: a + b, [s.is_blank(c).cast("int") for c in cells])
        # With at most one filled cell, that cell is all the row's text.
        amount = s.is_amount(F.concat_ws("", *cells))
        return label | ((blanks >= len(cols) - 1) & amount)

    # The cells are worked out once, however often the test looks at them.
    return F.exists(F.array(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])), test)


def repeated_header_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.where(is_repeated_header(df, columns))


def footer_total_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.where(is_footer_total(df, columns))


def duplicate_row_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows equal in all columns: how many, and the first of them."""
    cols = columns or text_columns(df)
    return (df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row")).where("n_rows > 1"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row, with that first row."""
    cols = columns or text_columns(df)
    rows = df.select("row_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    groups = duplicate_row_groups(df, cols)
    return rows.join(groups, cols).where("row_id > first_row").select("row_id", "first_row")


def file_profile(df: DataFrame, input_key: str = "input", columns: list[str] | None = None) -> DataFrame:
    """One row per input: size, flagged rows, duplicate rows, blank columns."""
    cols = columns or text_columns(df)
    blank = [F.count_if(~s.is_blank(F.col(c))).alias(f"n{i}") for i, c in enumerate(cols)]
    scan = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_repeated_header(df, cols)).alias("repeated_headers"),
                  F.count_if(is_footer_total(df, cols)).alias("footer_totals"), *blank)
    empties = reduce(lambda a, b: a + b, [(F.col(f"n{i}") == 0).cast("bigint") for i in range(len(cols))])
    dups = duplicate_row_groups(df, cols).agg(
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"))
    one = F.lit(1).alias("_one")
    return (scan.select("*", one).join(dups.select("*", one), "_one")
            .select(F.lit(input_key).alias("input_key"), "n_rows", F.lit(len(cols)).cast("bigint").alias("n_columns"),
                    "repeated_headers", "footer_totals", "duplicate_rows", "duplicate_groups", empties.alias("blank_columns")))


# ------------------------------------------------------------ which column is which

def semantic_scores(profile: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """Score of every (column, kind) whose header name fits."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("semantic"), F.array(*[F.lit(w) for w in ws]).alias("words"))
                                for k, ws in synonyms.items()]))
    snake = s.snake_case_col("column")
    named = profile.withColumn("snake", snake).withColumn("_k", kinds).select("*", "_k.semantic", "_k.words")
    name_score = (F.when(F.array_contains("words", F.col("snake")), 1.0)
                  .when(F.exists("words", lambda w: F.col("snake").contains(w) | w.contains(F.col("snake"))), 0.6))
    score = (F.when(F.col("semantic") == "date", 0.5 * F.col("name_score") + 0.5 * F.col("date_confidence"))
             .when(F.col("semantic") == "amount", 0.5 * F.col("name_score") + 0.5 * F.col("amount_confidence"))
             .otherwise(F.col("name_score")))
    return (named.withColumn("name_score", name_score).where("name_score is not null and snake <> ''")
            .withColumn("score", score).withColumn("exact", F.col("snake") == F.col("semantic"))
            .select("input_key", "semantic", "column", "position", "score", "exact"))


def semantic_mapping(profile: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS,
                     approved: DataFrame | None = None) -> DataFrame:
    """The best column per kind. A near-tie at the top caps the confidence at
    0.5 unless the leader carries the kind's own name; ``approved``
    (input_key, semantic, column) overrules the scores."""
    order = W.partitionBy("input_key", "semantic").orderBy(F.desc("score"), F.desc("exact"), "position")
    ranked = (semantic_scores(profile, synonyms)
              .withColumn("rn", F.row_number().over(order))
              .withColumn("next_score", F.lead("score").over(order)).withColumn("next_exact", F.lead("exact").over(order))
              .withColumn("n_candidates", F.count(F.lit(1)).over(W.partitionBy("input_key", "semantic")))
              .where("rn = 1"))
    near_tie = ((F.col("score") >= 0.6) & (F.col("score") - F.col("next_score") <= 0.1)
                & ~(F.col("exact") & ~F.col("next_exact")))
    conf = F.round(F.when(F.coalesce(near_tie, F.lit(False)), F.least("score", F.lit(0.5))).otherwise(F.col("score")), 4)
    auto = ranked.select("input_key", "semantic", s.snake_case_col("column").alias("mapped_column"), conf.alias("confidence"),
                         F.when(conf >= AUTO_CONFIDENCE, "auto").otherwise("unmapped").alias("source"), "n_candidates")
    if approved is None:
        return auto
    human = (approved.join(profile.select("input_key", s.snake_case_col("column").alias("_c")), "input_key")
             .where(F.col("_c") == s.snake_case_col("column"))
             .select("input_key", "semantic", F.col("_c").alias("mapped_column"), F.lit(1.0).alias("confidence"),
                     F.lit("human").alias("source"), F.lit(1).cast("bigint").alias("n_candidates")).distinct())
    return auto.join(human, ["input_key", "semantic"], "left_anti").unionByName(human)


def preflight_findings(mapping: DataFrame, profile: DataFrame, wanted: DataFrame) -> DataFrame:
    """Column findings: missing, ambiguous, or poorly readable columns.

    ``wanted``: input_key, semantic, required. A finding blocks the run iff its
    column is required.
    """
    parse = profile.select("input_key", s.snake_case_col("column").alias("mapped_column"), "date_confidence", "amount_confidence")
    rows = wanted.join(mapping, ["input_key", "semantic"], "left").join(parse, ["input_key", "mapped_column"], "left")
    unmapped = F.col("mapped_column").isNull()
    ambiguous = (~unmapped & (F.col("source") != "human") & (F.col("n_candidates") >= 2)
                 & (F.col("confidence") >= AMBIGUOUS_FROM) & (F.col("confidence") < AUTO_CONFIDENCE))
    low_date = ~unmapped & (F.col("semantic") == "date") & (F.col("date_confidence") < PARSE_CONFIDENCE)
    low_amount = ~unmapped & (F.col("semantic") == "amount") & (F.col("amount_confidence") < PARSE_CONFIDENCE)
    need = F.col("required")
    codes = F.array_compact(F.array(
        F.when(unmapped & need, F.lit("missing_required_column")), F.when(unmapped & need, F.lit("needs_human_configuration")),
        F.when(ambiguous, F.lit("ambiguous_column_mapping")), F.when(low_date, F.lit("low_date_parse_confidence")),
        F.when(low_amount, F.lit("low_amount_parse_confidence"))))
    return (rows.withColumn("code", F.explode(codes))
            .select("input_key", "semantic", "code", F.when(need, "high").otherwise("low").alias("severity"),
                    need.alias("blocks_run")))


def preflight_status(findings: DataFrame, inputs: DataFrame, key: str = "input_key") -> DataFrame:
    """FAIL with any blocking finding, PARTIAL with any finding above info, else
    PASS - for every input of ``inputs``, also those without findings."""
    agg = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("blocks_run").cast("int")).alias("blocks"),
        F.max((F.col("severity") != "info").cast("int")).alias("notable"))
    status = F.when(F.col("blocks") == 1, "FAIL").when(F.col("notable") == 1, "PARTIAL").otherwise("PASS")
    return inputs.select(key).distinct().join(agg, key, "left").select(
        key, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_findings"))


#: What to do about a finding, by its code; %s stands for the column.
ACTIONS = {
    "missing_required_column": "Add a %s column to the file.",
    "needs_human_configuration": "Name the column that holds the %s.",
    "ambiguous_column_mapping": "Confirm which column is the %s.",
    "low_date_parse_confidence": "Write the %s column in one date format.",
    "low_amount_parse_confidence": "Write the %s column as plain numbers.",
}


def suggested_action(code: str = "code", semantic: str = "semantic") -> Column:
    """The text of ``ACTIONS`` for a finding; null for other codes."""
    action = F.lit(None).cast("string")
    for name, text in ACTIONS.items():
        action = F.when(F.col(code) == name, F.format_string(text, F.col(semantic))).otherwise(action)
    return action


def preflight_steps(findings: DataFrame, key: str = "input_key") -> DataFrame:
    """What to do next, per input: key, step_no (from 1) and step, each text once in
    the order of ``position`` (null: last). While anything blocks the input only blocking
    findings give steps. Findings without an action give none.

    Rows are folded to distinct texts first, so the numbering runs over those only.
    """
    blocking = F.coalesce("blocks_run", F.lit(False))
    place = F.coalesce(F.col("position").cast("bigint"), F.lit(2**63 - 1))
    texts = (findings.groupBy(key, F.trim("action").alias("step"))
             .agg(F.min(place).alias("any_place"), F.min(F.when(blocking, place)).alias("block_place")))
    blocked = F.max(F.col("block_place").isNotNull()).over(W.partitionBy(key))
    at = F.when(F.col("blocked"), F.col("block_place")).otherwise(F.col("any_place"))
    listed = texts.withColumn("blocked", blocked).withColumn("at", at).where("at is not null and step <> ''")
    number = F.row_number().over(W.partitionBy(key).orderBy("at", "step"))
    return listed.select(key, number.cast("bigint").alias("step_no"), "step")


def supported_checks(status: DataFrame, checks: list[str], key: str = "input_key") -> DataFrame:
    """The checks of a workflow that run for each input: all unless its status is
    FAIL. Inputs without a status get none."""
    return status.where("status <> 'FAIL'").select(key, F.explode(F.array(*[F.lit(c) for c in checks])).alias("check"))
