"""Transaction search over ledger, invoices, checks and purchase orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.functions.similarity import containing_pairs, ratio_candidates, ratio_ceiling, sequence_ratio
from tieout.session import broadcast_if_small, cut_lineage

# Modules in result order with the columns searched in each.
MODULES: dict[str, dict[str, tuple[str, ...]]] = {
    "gl_detail": {"date": ("date",), "amount": ("amount", "debit", "credit")},
    "ap_invoice_detail": {"date": ("invoice_date",), "amount": ("invoice_amount",)},
    "check_register": {"date": ("check_date",), "amount": ("check_amount",)},
    "purchase_orders": {"date": ("po_date",), "amount": ("line_amount",)},
}
MODULE_NAMES = {"gl": "gl_detail", "ap": "ap_invoice_detail", "checks": "check_register", "po": "purchase_orders"}
MAX_RESULTS = 200
VENDOR_RATIO = 0.85

COLUMNS = ("vendor_name", "invoice_number", "po_number", "check_number", "fund", "department", "object_code")
_FROM = {"vendor_name": ("vendor_name", "vendor"), "department": ("org", "department"), "object_code": ("object", "object_code")}
# Exact criteria from the most to the least selective.
_EXACT = ("invoice_number", "po_number", "check_number", "object_code", "department", "fund")


def module_rows(df: DataFrame, module: str) -> DataFrame:
    """One module in the common search layout: keys, date, amount, all text."""
    def first(names: tuple[str, ...], dtype: str) -> Column:
        have = [F.col(n).cast(dtype) for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast(dtype)

    texts = [s.match_text(c) for c, t in df.dtypes if t == "string" and c != "row_id"]
    cols = [first(_FROM.get(c, (c,)), "string").alias(c) for c in COLUMNS]
    spec = MODULES[module]
    return df.select(F.lit(module).alias("module"), F.col("row_id").cast("string").alias("row_id"), *cols,
                     first(spec["date"], "date").alias("txn_date"), first(spec["amount"], s.MONEY).alias("amount"),
                     F.concat_ws(" ", *texts).alias("text"))


def all_modules(modules: dict[str, DataFrame]) -> DataFrame:
    """Union of the given modules; a filter on ``module`` prunes the others."""
    parts = [module_rows(modules[m], m) for m in MODULES if m in modules]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ single criteria

def search_vendor(rows: DataFrame, query: str, min_ratio: float | None = VENDOR_RATIO) -> DataFrame:
    """Vendor name contains the query or the other way round, else similar
    enough. Compared on distinct names, rows joined back. An empty query finds
    nothing."""
    q = s.match_text(F.lit(query))
    names = rows.select("vendor_name").distinct().withColumn("_n", s.match_text("vendor_name")).where((F.col("_n") != "") & (q != ""))
    contains = F.col("_n").contains(q) | q.contains(F.col("_n"))
    hits = names.where(contains).select("vendor_name")
    if min_ratio is not None:
        rest = names.where(~contains & (ratio_ceiling(F.col("_n"), q) >= min_ratio))
        hits = hits.unionByName(rest.withColumn("_q", q).where(sequence_ratio("_n", "_q") >= min_ratio).select("vendor_name"))
    return rows.join(hits, "vendor_name", "left_semi").select(*rows.columns)


def search_equal(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Reference numbers and dimensions: equal after normalising."""
    return rows.where(s.match_text(column) == s.match_text(F.lit(value)))


def search_date_range(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = rows.where("txn_date is not null") if start or end else rows
    if start:
        out = out.where(F.col("txn_date") >= F.lit(start).cast("date"))
    return out.where(F.col("txn_date") <= F.lit(end).cast("date")) if end else out


def search_amount_range(rows: DataFrame, low=None, high=None) -> DataFrame:
    """On the absolute amount, both ends included."""
    out = rows
    if low is not None:
        out = out.where(F.abs("amount") >= F.lit(low))
    return out.where(F.abs("amount") <= F.lit(high)) if high is not None else out


def search_keywords(rows: DataFrame, words: list[str]) -> DataFrame:
    """Any keyword anywhere in the row's text; without keywords, all rows."""
    return rows if not words else rows.where(reduce(lambda a, b: a | b, [F.col("text").contains(w.lower()) for w in words]))


# ------------------------------------------------------------ many searches at once

CRITERIA_COLUMNS = ("query_id", "vendor", "invoice_number", "po_number", "check_number", "fund", "department", "object_code",
                    "module", "date_from", "date_to", "amount_min", "amount_max", "keywords")


def _criteria(criteria: DataFrame) -> DataFrame:
    types = {"date_from": "date", "date_to": "date", "amount_min": s.MONEY, "amount_max": s.MONEY, "keywords": "array<string>"}
    return criteria.select(*[(F.col(c) if c in criteria.columns else F.lit(None)).cast(types.get(c, "string")).alias(f"q_{c}")
                             for c in CRITERIA_COLUMNS])


def batch_search(criteria: DataFrame, rows: DataFrame, min_ratio: float | None = VENDOR_RATIO) -> DataFrame:
    """Every criteria row against every transaction, as equi-joins.

    Each criteria row meets transactions on its most selective exact value
    (number, dimension, else vendor name, else month of the transaction), then
    the remaining conditions are tested. Vendor fragments are resolved on
    distinct vendor names first.
    """
    crit = _criteria(criteria)
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    exact = F.coalesce(*[F.when(filled(f"q_{c}"), F.struct(F.lit(c).alias("kind"), s.match_text(f"q_{c}").alias("value")))
                         for c in _EXACT])
    keyed = crit.withColumn("_key", exact).withColumns({f"w_{c}": s.match_text(f"q_{c}") for c in _EXACT})

    # Vendor fragments to the vendor names they match.
    names = (rows.select("vendor_name").distinct().withColumn("name", s.match_text("vendor_name")).where("name <> ''")
             .select("name").distinct())
    asked = crit.where(filled("q_vendor")).select(s.match_text("q_vendor").alias("name")).where("name <> ''").distinct()
    vendor_hits = containing_pairs(names, asked)
    if min_ratio is not None:
        alike = ratio_candidates(names, asked, min_ratio).where(~F.contains("a", "b") & ~F.contains("b", "a"))
        vendor_hits = vendor_hits.unionByName(alike.where(sequence_ratio("a", "b") >= min_ratio))
    vendor_hits = vendor_hits.select(F.col("a").alias("name"), F.col("b").alias("asked"))

    by_vendor = keyed.where(filled("q_vendor")).join(vendor_hits, s.match_text("q_vendor") == F.col("asked")).drop("asked")
    by_vendor = by_vendor.withColumn("_key", F.coalesce("_key", F.struct(F.lit("vendor_name").alias("kind"), F.col("name").alias("value"))))
    no_vendor = keyed.where(~filled("q_vendor")).withColumn("name", F.lit(None).cast("string"))
    direct = by_vendor.unionByName(no_vendor.where("_key is not null"))

    # Neither key nor vendor: by the months between the first and last date that occur.
    span = rows.agg(F.min("txn_date").alias("lo"), F.max("txn_date").alias("hi")).withColumn("_one", F.lit(1))
    start = F.trunc(F.greatest(F.coalesce("q_date_from", "lo"), F.col("lo")), "month")
    end = F.trunc(F.least(F.coalesce("q_date_to", "hi"), F.col("hi")), "month")
    covered = F.when(start <= end, F.transform(F.sequence(start, end, F.expr("interval 1 month")),
                                               lambda m: F.date_format(m, "yyyy-MM")))
    undated = F.when(F.col("q_date_from").isNull() & F.col("q_date_to").isNull(), F.array(F.lit("none")))
    empty = F.array().cast("array<string>")
    by_month = (no_vendor.where("_key is null").withColumn("_one", F.lit(1)).join(span, "_one")
                .withColumn("_m", F.explode(F.concat(F.coalesce(covered, empty), F.coalesce(undated, empty))))
                .withColumn("_key", F.struct(F.lit("month").alias("kind"), F.col("_m").alias("value")))
                .select(*direct.columns))
    wanted = direct.unionByName(by_month).withColumns({"kind": F.col("_key.kind"), "value": F.col("_key.value")}).drop("_key")

    # The resolved criteria are materialised once, broadcast if they are few, and
    # tell which keys (at most eight), which columns and whether row texts are needed at all.
    wanted = cut_lineage(wanted)
    used = {r["kind"] for r in wanted.select("kind").distinct().collect()}
    asks = wanted.agg(*[F.bool_or(F.col(f"w_{c}") != "").alias(c) for c in _EXACT], F.bool_or(F.col("name").isNotNull()).alias("vendor_name"),
                      F.bool_or(F.size("q_keywords") > 0).alias("text")).first().asDict()
    by_text = asks["text"]
    wanted = broadcast_if_small(wanted)
    # Keys are normalised once, before rows are copied per key.
    rows = rows.withColumns({f"n_{c}": s.match_text(c) for c in (*_EXACT, "vendor_name") if c in used or asks[c]})
    keys = [F.struct(F.lit(c).alias("kind"), F.col(f"n_{c}").alias("value")) for c in (*_EXACT, "vendor_name") if c in used]
    if "month" in used or not keys:
        keys.append(F.struct(F.lit("month").alias("kind"), F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("none")).alias("value")))
    spread = rows.withColumn("_k", F.explode(F.array(*keys))).select("*", "_k.kind", "_k.value").drop("_k").where("value <> ''")

    tests = []
    for c in _EXACT:
        if asks[c]:
            tests.append((F.col(f"w_{c}") == "") | (F.col(f"n_{c}") == F.col(f"w_{c}")))
    if asks["vendor_name"]:
        tests.append(F.col("name").isNull() | (F.col("n_vendor_name") == F.col("name")))
    module = F.coalesce(F.create_map(*[F.lit(x) for kv in MODULE_NAMES.items() for x in kv])[F.col("q_module")], F.col("q_module"))
    tests.append(~filled("q_module") | (F.col("module") == module))
    tests.append(F.col("q_date_from").isNull() | (F.col("txn_date") >= F.col("q_date_from")))
    tests.append(F.col("q_date_to").isNull() | (F.col("txn_date") <= F.col("q_date_to")))
    tests.append(F.col("q_amount_min").isNull() | (F.abs("amount") >= F.col("q_amount_min")))
    tests.append(F.col("q_amount_max").isNull() | (F.abs("amount") <= F.col("q_amount_max")))
    if by_text:
        tests.append((F.coalesce(F.size("q_keywords"), F.lit(0)) <= 0)
                     | F.exists("q_keywords", lambda k: F.col("text").contains(F.lower(k))))
    cond = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])
    return (spread.join(wanted, ["kind", "value"]).where(cond)
            .select(F.col("q_query_id").alias("query_id"), "module", "row_id", "txn_date", "amount"))


def module_rank() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODULES]), F.col("module"))


def capped_search(matches: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """First ``limit`` matches per query in module and row order (a top-k
    report), with whether there were more."""
    order = W.partitionBy("query_id").orderBy(module_rank(), "row_id")
    # one row more than is shown tells whether there is more; no other row leaves its task
    top = matches.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit + 1)
    more = F.max("position").over(W.partitionBy("query_id")) > limit
    return (top.withColumn("truncated", more).where(F.col("position") <= limit)
            .select("query_id", "position", "module", "row_id", "txn_date", "amount", "truncated"))


def search_summary(matches: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """Matches and signed total per query and module."""
    by = matches.groupBy("query_id", "module").agg(F.count(F.lit(1)).alias("n_matches"),
                                                   F.sum("amount").cast("decimal(28,2)").alias("total_signed_amount"))
    return by.withColumn("truncated", F.sum("n_matches").over(W.partitionBy("query_id")) > limit)  # over a row per module
