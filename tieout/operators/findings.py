"""Findings: one layout for what every rule reports, and what is done with it.

A findings table has one row per finding: run_id, finding_id, finding_type,
severity, rule_used, description, computed_values (map), requires_human_review.
The cited rows are a second table, finding_refs: finding_id, table_name,
row_id. A rule may cite any number of rows, so they are never an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.session import broadcast_if_small, cut_lineage

# Severities from the most to the least severe.
SEVERITIES = ("critical", "high", "medium", "low", "info")
PROMPT_LIMIT = 150
# Words of rules about a row one document lacks.
ONE_SIDED_MARKERS = ("unmatched", "without_match", "without_bank_match", "without_ledger_match", "no_match", "missing")

# Rule -> (finding type, severity, needs review).
RULES: dict[str, tuple[str, str, bool]] = {
    "matched": ("matched", "info", False), "timing_difference": ("timing_difference", "medium", True),
    "unmatched_bank": ("unmatched_bank", "high", True), "unmatched_ledger": ("unmatched_ledger", "high", True),
    "possible_duplicate": ("duplicate", "medium", True),
    "duplicate_invoice_number": ("duplicate_payment", "high", True),
    "invoice_paid_by_multiple_checks": ("duplicate_payment", "high", True),
    "same_vendor_same_amount_near_date": ("duplicate_payment", "medium", True),
    "similar_vendor_names_same_amount": ("vendor_anomaly", "medium", True),
    "missing_po_over_threshold": ("missing_reference", "medium", True),
    "payment_before_invoice_date": ("duplicate_payment", "medium", True),
    "inactive_vendor_payment": ("vendor_anomaly", "high", True),
    "unknown_vendor_payment": ("missing_reference", "high", True),
    "split_payment_pattern": ("duplicate_payment", "high", True),
    "invoice_exceeds_po": ("po_mismatch", "high", True), "wrong_vendor": ("po_mismatch", "high", True),
    "missing_po": ("missing_reference", "high", True), "closed_po_usage": ("po_mismatch", "medium", True),
    "unit_price_mismatch": ("po_mismatch", "medium", True), "quantity_mismatch": ("po_mismatch", "medium", True),
    "received_not_invoiced": ("po_mismatch", "low", False), "invoiced_not_received": ("po_mismatch", "medium", True),
    "subtotal_equals_line_item_sum": ("consistency", "high", True), "grand_total_ties_out": ("consistency", "high", True),
    "required_section_present": ("consistency", "high", True), "no_duplicate_account_lines": ("duplicate", "medium", True),
    "no_unexpected_negative_values": ("consistency", "medium", True),
    "account_code_in_chart_of_accounts": ("consistency", "high", True),
    "consistent_account_naming": ("consistency", "medium", True),
    "large_change_from_prior_version": ("consistency", "medium", True),
}


def severity_rank(c: Column | str = "severity") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    pos = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), col)
    return F.when(pos > 0, pos - 1).otherwise(len(SEVERITIES))


def to_findings(rows: DataFrame, rule: str, key: list[str], values: list[str], run_id: Column,
                finding_type: str | None = None, severity: Column | None = None) -> DataFrame:
    """Rows of a rule as findings. The id is a hash of rule and key, so a rerun
    gives the same ids."""
    if rule not in RULES and finding_type is None:
        raise ValueError(f"unknown rule {rule!r}: give its finding_type")
    kind, sev, review = RULES.get(rule, (finding_type, "info", False))
    ident = F.sha2(F.concat_ws("|", F.lit(rule), *[F.col(k).cast("string") for k in key]), 256)
    pairs = [x for v in values for x in (F.lit(v), F.coalesce(F.col(v).cast("string"), F.lit("")))]
    text = F.concat(F.lit(rule.replace("_", " ") + ": "), F.concat_ws(", ", *[
        F.concat(F.lit(v + " "), F.coalesce(F.col(v).cast("string"), F.lit(""))) for v in values]))
    return rows.select(run_id.alias("run_id"), ident.alias("finding_id"), F.lit(finding_type or kind).alias("finding_type"),
                       (severity if severity is not None else F.lit(sev)).alias("severity"), F.lit(rule).alias("rule_used"),
                       text.alias("description"), F.create_map(*pairs).alias("computed_values"),
                       F.lit(review).alias("requires_human_review"))


_DIMENSIONS = {"rule": "rule_used", "severity": "severity", "finding_type": "finding_type"}


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts per run by rule, by severity, by type and in total, in one pass."""
    return _grouped(findings).drop("n_notable")


def _grouped(findings: DataFrame) -> DataFrame:
    names = list(_DIMENSIONS.values())
    base = findings.select("run_id", *names, "requires_human_review")
    grouped = base.groupingSets([["run_id", c] for c in names] + [["run_id"]], "run_id", *names).agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_if("requires_human_review").alias("n_review"),
        F.count_if(F.col("severity") != "info").alias("n_notable"), F.grouping_id().alias("_g"))
    # Bits of the grouping id (run, rule, severity, type): 1 where the column is folded away.
    dim = F.when(F.col("_g") == 3, "rule").when(F.col("_g") == 5, "severity").when(F.col("_g") == 6, "finding_type").otherwise("total")
    return grouped.select("run_id", dim.alias("dimension"), F.coalesce(*names, F.lit("")).alias("value"), "n_findings", "n_review", "n_notable")


def derived_counts(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """(run_id, n): every count a summary may state about its findings."""
    limit = F.lit(PROMPT_LIMIT).cast("bigint")
    n = F.col("n_findings")
    # Per dimension a run has a handful of values (rules, severities, types).
    dims = _grouped(findings).groupBy("run_id", "dimension").agg(
        F.collect_set("n_findings").alias("_sizes"), F.count(F.lit(1)).alias("_groups"), F.max("n_findings").alias("n_findings"),
        F.max("n_review").alias("n_review"), F.max("n_notable").alias("n_notable"))
    totals = F.when(F.col("dimension") == "total", F.concat(
        F.array("n_findings", "n_review", "n_notable"), F.when(n > limit, F.array(limit, n - limit)).otherwise(F.array().cast("array<bigint>"))))
    per_group = F.array_append("_sizes", F.col("_groups"))
    stated = dims.select("run_id", F.explode(F.coalesce(totals, per_group)).alias("n"))
    cited = refs.join(findings.select("run_id", "finding_id").distinct(), "finding_id")
    seen = cited.groupBy("run_id").agg(F.count_distinct("finding_id").alias("a"), F.count_distinct("table_name", "row_id").alias("b"),
                                       F.count_distinct("table_name").alias("c"))
    return stated.unionByName(seen.select("run_id", F.explode(F.array("a", "b", "c")).alias("n"))).distinct()


def top_findings(findings: DataFrame, order: str, limit: int = PROMPT_LIMIT) -> DataFrame:
    """The most severe findings per run (a top-k report), with how many were
    left out. ``order`` is the file order, which also breaks ties."""
    rank = W.partitionBy("run_id").orderBy(severity_rank(), order)
    top = findings.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit)
    total = findings.groupBy("run_id").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("n_omitted"))
    return top.join(total, "run_id").drop("_rank")


def source_values_for_refs(refs: DataFrame, rows: DataFrame, table_name: str, columns: list[str]) -> DataFrame:
    """Cell values of the cited rows of one table, one line per cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("cell"))
                                for c in columns]))
    wanted = refs.where(F.col("table_name") == table_name).select("finding_id", "row_id")
    return wanted.join(rows.select("row_id", *columns), "row_id").select("finding_id", F.lit(table_name).alias("table_name"),
                                                                         "row_id", cells.alias("_c")).select(
        "finding_id", "table_name", "row_id", "_c.column_name", "_c.cell")


def source_evidence(findings: DataFrame, cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cited cells with the file they came from; a cell is highlighted when it
    equals a computed value as text, amount or date."""
    amount = lambda c: s.parse_amount(c).cast("string")
    day = lambda c: s.parse_date(c).cast("string")

    def forms(c: Column) -> Column:
        return F.array_compact(F.array(F.concat(F.lit("t:"), c), F.concat(F.lit("a:"), amount(c)), F.concat(F.lit("d:"), day(c))))

    keys = ["finding_id", "table_name", "row_id", "column_name"]
    # A finding travels once, with its values as they are; their forms are made where they arrive.
    values = findings.where("finding_id is not null").select("finding_id", F.explode(F.map_values("computed_values")).alias("v"))
    computed = values.groupBy("finding_id").agg(F.collect_set("v").alias("_v")).select("finding_id", F.flatten(F.transform("_v", forms)).alias("_forms"))
    own = F.coalesce(F.arrays_overlap(forms(F.col("cell")), "_forms"), F.lit(False)) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # Partitioned by finding for the join, the lines of one cell are together already.
    hot = F.max("_own").over(W.partitionBy(*keys))
    files = broadcast_if_small(cut_lineage(manifest.select("table_name", "file_name", "sha256")))
    return (cells.join(computed, "finding_id", "left").select(*keys, "cell", own.alias("_own")).withColumn("highlighted", hot)
            .join(files, "table_name", "left").select(*keys, "cell", "highlighted", "file_name", "sha256"))


def missing_documents(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """For findings about a row only one document has: the run's documents they
    do not cite."""
    cited = refs.select("finding_id", "table_name").distinct()
    marker = "|".join(ONE_SIDED_MARKERS)
    one = cited.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"), F.min("table_name").alias("cited_table")).where("n = 1")
    sided = findings.where(F.col("finding_type").rlike(marker) | F.col("rule_used").rlike(marker)).select("run_id", "finding_id").join(
        one, "finding_id")
    docs = cited.join(findings.select("run_id", "finding_id"), "finding_id").select("run_id", "table_name").distinct()
    return sided.join(docs, "run_id").where("table_name <> cited_table").select(
        "run_id", "finding_id", "cited_table", F.col("table_name").alias("missing_document"))


# Parts of a result that differ from run to run.
VOLATILE = (r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}"
            r"|\d{4}-\d{2}-\d{2}T[\d:.]+(?:[+-]\d{2}:\d{2}|Z)?")


def result_digest(df: DataFrame) -> DataFrame:
    """One row: count and a hash that does not depend on row order or
    partitioning. Row hashes are added up (four 60-bit parts), not collected."""
    row = F.sha2(F.regexp_replace(F.to_json(F.struct(*sorted(df.columns))), VOLATILE, "*"), 256)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(4)]
    sums = df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return sums.select("n_rows", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(4)]), 256)
                       .alias("digest"))
