"""Exported files in, typed tables out."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators import profiling
from tieout.sources import datasets as ds
from tieout.sources.records import cells, header_names, read_records

TITLE_ROWS = 10  # Fixed value: by default a title block is looked for in this many lines


def with_row_index(df: DataFrame, name: str = "source_row_index") -> DataFrame:
    """0-based position of each row within its file.

    Parquet knows it. For text files each split is a run of consecutive rows:
    its own row numbers are shifted by the rows of the splits before it, which
    costs a count per split and no sort.
    """
    meta = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))
    splits = meta.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    index = (F.col("_mid") - F.col("_first") + F.col("_off")).alias(name)
    return meta.join(offsets, ["_file", "_block"]).select(*df.columns, F.col("_file").alias("source_file"), index)


def read_parquet_indexed(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"),
                     F.col("_metadata.row_index").alias("source_row_index"))


def read_export(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Delimited files with a header record; every cell text, blanks kept as ''.
    Quoted cells may hold line breaks; rows are numbered by record.

    Files may order their columns in their own way: one plan reads all of them and
    places cells by column name. A column that a file lacks is blank there.
    """
    rows = read_records(spark, path, delimiter).where("record <> ''")
    headers = rows.where("row_number = 0").select("source_file", F.col("record").alias("header"))
    layouts = [(h.header, header_names(h.header, delimiter)) for h in headers.select("header").distinct().orderBy("header").collect()]  # a row per layout
    names = list(dict.fromkeys(n for _, layout in layouts for n in layout))
    data = rows.where("row_number > 0").select("source_file", (F.col("row_number") - 1).alias("source_row_index"),
                                               cells("record", max((len(x) for _, x in layouts), default=0), delimiter).alias("_cells"))
    if len(layouts) < 2:
        placed = [F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    else:
        known = spark.createDataFrame(layouts, "header string, _names array<string>")
        data = data.join(headers.join(known, "header").select("source_file", "_names"), "source_file")
        at = [F.array_position("_names", n) for n in names]
        placed = [F.when(i > 0, F.element_at("_cells", i.cast("int"))).otherwise(F.lit("")).alias(n) for i, n in zip(at, names)]
    return data.select(*placed, "source_file", "source_row_index")


# ------------------------------------------------------------ where the header is


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_row_index, line."""
    lines = spark.read.text(path)
    return with_row_index(lines.select("value")).withColumnRenamed("value", "line")


def top_lines(spark: SparkSession, path: str, n: int = TITLE_ROWS + 1) -> DataFrame:
    """The first ``n`` lines of every file. They sit in its first split, so
    their numbers need no count of the splits before."""
    lines = spark.read.text(path)
    first = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_mid")).where("_b = 0")
    start = first.groupBy("source_file").agg(F.min("_mid").alias("_s"))
    return first.join(start, "source_file").where(F.col("_mid") - F.col("_s") < n).select(
        "source_file", (F.col("_mid") - F.col("_s")).alias("source_row_index"), F.col("value").alias("line"))


def _cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of a header or title line; a delimiter inside quotes does not count."""
    parts = F.split(line, re.escape(delimiter) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), '""', '"')))


def skip_title_block(lines: DataFrame, delimiter: str = ",", title_rows: int = TITLE_ROWS) -> DataFrame:
    """Header line number per file, looked for in the first ``title_rows`` lines
    and the one below them. The first line with two or more filled cells
    is the header if it has no amounts or dates and neither do the lines above;
    otherwise line 0 is."""
    top = (lines.where(F.col("source_row_index") <= title_rows)
           .withColumn("filled", F.filter(_cells(F.col("line"), delimiter), lambda c: c != "")))
    top = top.withColumn("wide", F.size("filled") >= 2).withColumn(
        "has_value", F.exists("filled", lambda c: s.is_amount(c) | s.parse_date(c).isNotNull()))
    first = top.groupBy("source_file").agg(F.min(F.when(F.col("wide"), F.col("source_row_index"))).alias("first_wide"))
    head = top.join(first, "source_file").where(F.col("source_row_index") <= F.coalesce("first_wide", F.lit(-1)))
    ok = head.groupBy("source_file").agg(F.max("first_wide").alias("idx"), F.max(F.col("has_value").cast("int")).alias("bad"))
    return (first.select("source_file").join(ok, "source_file", "left")
            .select("source_file", F.when(F.coalesce(F.col("bad"), F.lit(1)) == 0, F.col("idx")).otherwise(F.lit(0)).alias("header_row")))


def read_titled_export(spark: SparkSession, path: str, delimiter: str = ",", title_rows: int = TITLE_ROWS) -> DataFrame:
    """Files of one layout below a title block: all-text columns named by the
    header line, rows numbered from 0 below it. A blank header cell keeps its
    place as ``unnamed_<position>``; files with different headers are refused."""
    records = read_records(spark, path, delimiter)
    top = records.where(F.col("line_number") <= title_rows).select("source_file", F.col("line_number").alias("source_row_index"), F.col("record").alias("line"))
    header = skip_title_block(top, delimiter, title_rows)
    headed = records.join(header, "source_file")
    at = headed.where("line_number = header_row").select("source_file", F.col("row_number").alias("_head"), "record")
    kinds = [r.record for r in at.select("record").distinct().limit(2).collect()]
    if len({tuple(header_names(k, delimiter)) for k in kinds}) > 1:
        raise ValueError(f"the files under {path} have different headers")
    names = [f"unnamed_{i}" if n == f"_c{i}" else n.strip() for i, n in enumerate(header_names(kinds[0], delimiter))] if kinds else []
    rows = headed.where("line_number > header_row and record <> ''").join(at.select("source_file", "_head"), "source_file")
    return rows.withColumn("_cells", cells("record", len(names), delimiter)).select(
        *[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "source_file", (F.col("row_number") - F.col("_head") - 1).alias("source_row_index"))


# ------------------------------------------------------------ which layout it is


def _column_bits() -> tuple[dict[str, list[int | None]], dict[str, list[int | None]]]:
    """Per header form, as written and spelled out: for every layout the bit of the
    column it names; 0 names no column of the layout, None leaves the form open."""
    written: dict[str, list[int | None]] = {}
    spelled: dict[str, list[int | None]] = {}
    for i, d in enumerate(ds.DATASETS.values()):
        bits = {c: 1 << k for k, c in enumerate(d.columns)}
        named = {form: bits.get(c, 0) for form, c in ds.counted_aliases(d).items()}
        for out, forms in ((written, {**named, **bits}), (spelled, {**bits, **named})):
            for form, bit in forms.items():
                out.setdefault(form, [None] * len(ds.DATASETS))[i] = bit
    return written, spelled


def _layout_scores(headers: DataFrame, file_cols: list[str]) -> DataFrame:
    """Per file ``_scores``, an entry per layout. The columns a file has are bits of one
    number per layout, so a file keeps as many numbers however many headers it has."""
    snake = s.snake_case_col("header")
    words = F.create_map(*[F.lit(x) for kv in ds.WORDS.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(F.col("_snake"), "_"), lambda w: F.coalesce(words[w], w)), "_")
    maps = [F.create_map(*[x for form, row in forms.items() for x in (F.lit(form), F.array(*[F.lit(b).cast("bigint") for b in row]))])
            for forms in _column_bits()]
    rows = headers.select(*file_cols, snake.alias("_snake")).select(*file_cols, maps[0][F.col("_snake")].alias("_w"), maps[1][spelled].alias("_s"))
    none = F.lit(0).cast("bigint")
    has = [F.coalesce(F.bit_or(F.coalesce(F.get("_w", F.lit(i)), F.get("_s", F.lit(i)), none)), none).alias(f"_has{i}") for i in range(len(ds.DATASETS))]
    entries = []
    for i, d in enumerate(ds.DATASETS.values()):
        req = (1 << len(d.required)) - 1
        matched = [F.bit_count(F.col(f"_has{i}").bitwiseAND(F.lit(m).cast("bigint"))).cast("bigint") for m in (req, ((1 << len(d.columns)) - 1) ^ req)]
        score = 0.8 * (matched[0] / F.lit(len(d.required))) + 0.2 * F.coalesce(F.try_divide(matched[1], F.lit(len(d.optional))), F.lit(0.0))
        entries.append(F.struct(F.lit(d.name).alias("dataset_type"), matched[0].alias("required_matched"), matched[1].alias("optional_matched"),
                                F.round(score, 4).alias("score")))
    return rows.groupBy(*file_cols).agg(*has).select(*file_cols, F.array(*entries).alias("_scores"))


def header_scores(headers: DataFrame, file_cols: list[str]) -> DataFrame:
    """Score of every layout for every file of a (file, header) table:
    0.8 x share of required columns + 0.2 x share of optional ones."""
    return _layout_scores(headers, file_cols).select(*file_cols, F.explode("_scores").alias("_e")).select(*file_cols, "_e.*")


def detect_dataset_type(headers: DataFrame, file_cols: list[str] | None = None) -> DataFrame:
    """Best layout per file, null below the minimum score or on a near-tie."""
    keys = file_cols or ["file_id"]
    order = F.array_sort(F.transform("_scores", lambda e: F.struct((-e["score"]).alias("low"), e["dataset_type"].alias("dataset_type"), e["score"].alias("score"))))
    best = (_layout_scores(headers, keys).select(*keys, order.alias("_o"))
            .select(*keys, F.get("_o", F.lit(0))["dataset_type"].alias("dataset_type"), F.get("_o", F.lit(0))["score"].alias("score"),
                    F.get("_o", F.lit(1))["score"].alias("second")))
    sure = (F.col("score") >= ds.MIN_SCORE) & (F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 4) >= ds.MIN_MARGIN)
    return best.select(*keys, F.when(sure, F.col("dataset_type")).alias("dataset_type"), "score", F.col("second").alias("second_score"))


def header_row_by_overlap(lines: DataFrame, delimiter: str = ",", scan_rows: int = ds.HEADER_SCAN_ROWS) -> DataFrame:
    """Per file the line, of the first ``scan_rows``, that fits a layout best (at least 0.5, the
    earliest on a tie); no row for a file without one."""
    top = lines.where(F.col("source_row_index") < scan_rows).withColumn(
        "filled", F.filter(_cells(F.col("line"), delimiter), lambda c: c != "")).where(F.size("filled") >= 2)
    headers = top.select("source_file", "source_row_index", F.explode("filled").alias("header"))
    scores = header_scores(headers, ["source_file", "source_row_index"]).where(F.col("score") >= ds.MIN_HEADER_SCORE)
    return scores.groupBy("source_file").agg(
        F.min_by(F.struct(F.col("source_row_index").alias("header_row"), F.col("score")),
                 F.struct(-F.col("score"), F.col("source_row_index"))).alias("b")).select("source_file", "b.header_row", "b.score")


# ------------------------------------------------------------ typed tables


def canonicalize_columns(df: DataFrame, dataset_type: str) -> DataFrame:
    """Columns renamed to the layout's names; nothing dropped or reordered."""
    names = ds.resolve(df.columns, ds.DATASETS[dataset_type])
    return df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns])


def _derive_layout(df: DataFrame, spec: ds.DatasetSpec, flagged: Column) -> DataFrame:
    """Columns some layouts combine: number and name of the vendor in one cell,
    year and period in one cell, one signed amount instead of debit and credit."""
    have = set(df.columns)
    if {"vendor_number", "vendor_name"} <= set(spec.columns):
        both = {"vendor_number", "vendor_name"} & have
        column = "vendor" if "vendor" in have and len(both) < 2 else next(iter(both)) if len(both) == 1 else None
        if column:
            # One scan decides: do all filled cells start with a number, and do
            # all hold a number and a name?
            gate = df.where(~s.is_blank(column) & ~flagged).agg(
                F.coalesce(F.bool_and(F.trim(column).rlike(r"^\d+(\s|$)")), F.lit(False)).alias("ids"),
                F.coalesce(F.bool_and(s.split_vendor(column)[0]), F.lit(False)).alias("all_fit")).head()
            if column == "vendor":
                target = "vendor_number" if gate["ids"] else "vendor_name"
                if target not in have:
                    df = df.withColumnRenamed("vendor", target)
                    both, column = both | {target}, target
            if len(both) == 1 and gate["all_fit"]:
                fits, number, name = s.split_vendor(column)
                keep = F.coalesce(F.col(column), F.lit(""))
                df = df.withColumns({
                    "vendor_number": F.when(fits, number).otherwise(keep if column == "vendor_number" else F.lit("")),
                    "vendor_name": F.when(fits, name).otherwise(keep if column == "vendor_name" else F.lit(""))})
            have = set(df.columns)
    if {"fiscal_year", "period"} <= set(spec.required) and "yr_pr" in have and not {"fiscal_year", "period"} & have:
        year, period, unposted = s.split_year_period("yr_pr")
        df = df.withColumns({"fiscal_year": year, "period": period, "unposted": unposted})
    if {"debit", "credit"} <= set(spec.required) and "amount" in have and not {"debit", "credit"} & have:
        debit, credit = s.split_signed_amount(s.parse_amount("amount"))
        df = df.withColumns({"debit": F.coalesce(debit.cast("string"), F.lit("")),
                             "credit": F.coalesce(credit.cast("string"), F.lit(""))})
    return df


def normalize_export(df: DataFrame, dataset_type: str, row_id: str = "source_row_index",
                     as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed rows, rejects, warnings) of an all-text export.

    Repeated header lines and footers are flagged and kept. A filled cell of a
    date or amount column that cannot be read is a reject unless its row is
    flagged. Serial-number dates are read when ``as_of`` is given. Missing
    required columns raise at once. Warnings: code, row_id.
    """
    spec = ds.DATASETS[dataset_type]
    base = canonicalize_columns(df, dataset_type)
    text = [c for c in base.columns if c not in (row_id, "source_file")]
    flags = {"is_repeated_header": profiling.is_repeated_header(base, text),
             "is_footer_total": profiling.is_footer_total(base, text)}
    base = _derive_layout(base.withColumns(flags), spec, F.col("is_repeated_header") | F.col("is_footer_total"))
    missing = [c for c in spec.required if c not in base.columns]
    if missing:
        raise ValueError(f"{dataset_type}: missing required columns {missing}, found {base.columns}")

    dates = [c for c in spec.dates if c in base.columns]
    amounts = [c for c in spec.amounts if c in base.columns]
    typed = {}
    for c in dates:
        serial = s.excel_serial_date(c, F.lit(as_of)) if as_of else F.lit(None).cast("date")
        typed[c] = F.coalesce(s.parse_date(c), serial)
    for c in amounts:
        typed[c] = s.parse_amount(c)
    bad = [F.when(~s.is_blank(c) & v.isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, v in typed.items()]
    flagged = F.col("is_repeated_header") | F.col("is_footer_total")
    rejects = base.where(~flagged).select(F.col(row_id), F.explode(F.array_compact(F.array(*bad))).alias("_b")).select(
        row_id, "_b.column", "_b.value") if bad else base.limit(0).select(row_id, F.lit("").alias("column"), F.lit("").alias("value"))

    codes = [F.when(F.col("is_repeated_header"), F.lit("repeated_header_rows")), F.when(F.col("is_footer_total"), F.lit("footer_total_rows"))]
    if as_of:
        # few cells are serial numbers, so only those are tried as written dates
        codes += [F.when(s.excel_serial_date(c, F.lit(as_of)).isNotNull() & s.parse_date(c).isNull(), F.lit(f"excel_serial_dates:{c}"))
                  for c in dates]
    if "unposted" in base.columns:
        codes.append(F.when(F.col("unposted"), F.lit("unposted_journals")))
    warnings = base.select(row_id, F.explode(F.array(*codes)).alias("code")).where("code is not null")

    out = base.withColumns(typed) if typed else base
    if {"debit", "credit"} <= set(amounts) and "amount" not in base.columns:
        out = out.withColumn("amount", s.signed_amount(F.col("debit"), F.col("credit")).cast(s.QTY))
    return out, rejects, warnings


def require_clean(rejects: DataFrame) -> None:
    """Stop when any cell was rejected (a few are named in the message)."""
    some = rejects.take(5)
    if some:
        raise ValueError(f"unreadable cells, for example {[r.asDict() for r in some]}")


def unposted_journals(df: DataFrame, column: str = "yr_pr") -> DataFrame:
    """Rows whose year/period is marked unposted; they stay in the data."""
    year, period, unposted = s.split_year_period(column)
    return df.withColumns({"fiscal_year": year, "period": period, "unposted": unposted}).where("unposted")


# Header names of a chart's code and name columns, best first.
CODE_HEADERS = ("account_code", "account", "code", "account_number", "acct")
NAME_HEADERS = ("account_name", "name", "description", "account_description")


def accounts_reference(chart: DataFrame, order: str = "source_row_index") -> DataFrame:
    """(account_code, account_name): blank codes dropped, the last name of a
    repeated code kept; the two columns are found by header."""
    names = {s.snake_case(c): c for c in chart.columns}
    code = next((names[c] for c in CODE_HEADERS if c in names), None)
    if code is None:
        return chart.limit(0).select(F.lit("").alias("account_code"), F.lit("").alias("account_name"))
    title = next((names[c] for c in NAME_HEADERS if c in names), None)
    rows = chart.select(s.text_key(code).alias("account_code"),
                        (s.text_key(title) if title else F.lit("")).alias("account_name"), F.col(order).alias("_o"))
    return rows.where("account_code <> ''").groupBy("account_code").agg(F.max_by("account_name", "_o").alias("account_name"))


def text_context(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """(name, text) of the text files under a folder, whole unless ``max_chars``."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_replace("_metadata.file_path", "^.*" + re.escape(path.rstrip("/").split("/")[-1]) + "/", "")
    text = F.substring("value", 1, max_chars) if max_chars else F.col("value")
    return raw.select(name.alias("name"), text.alias("text")).where(F.lower("name").rlike(r"\.(txt|md|markdown|rst)$"))
