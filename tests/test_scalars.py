import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.functions import scalars as s


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_amounts(spark):
    cells = ["$1,234.50", "(40.00)", "12.00-", "-5", "", "abc", ".00", "1 234", "($7.25)", "-$3", "1e5", "nan", None, "12.", "--", "(", "5)"]
    want = ["1234.50", "-40", "-12", "-5", None, None, "0", "1234", "-7.25", "-3", None, None, None, "12", None, None, None]
    got = column(spark, cells, s.parse_amount)
    assert got == [None if w is None else Decimal(w) for w in want]


def test_amount_text(spark):
    got = column(spark, ["$1,234.50", "(40.00)", "12.00-", "−5", "", " ", "-7"], s.clean_amount_text)
    assert got == ["1234.50", "-40.00", "-12.00", "-5", "", " ", "-7"]


def test_dates(spark):
    d = dt.date(2024, 3, 5)
    cells = ["2024-03-05", "03/05/2024", "3/5/24", "2024/03/05", "03-05-2024", "05-Mar-2024", "Mar 5, 2024", "March 5, 2024", " 2024-3-5 "]
    assert column(spark, cells, s.parse_date) == [d] * len(cells)
    edge = ["25/12/2023", "1/1/68", "1/1/69", "2023-02-30", "", "45678", "13/13/2024", None, "hello", "May 1, 2024", "Sept 1, 2024"]
    assert column(spark, edge, s.parse_date) == [dt.date(2023, 12, 25), dt.date(2068, 1, 1), dt.date(1969, 1, 1), None, None, None, None, None,
                                                 None, dt.date(2024, 5, 1), None]


def test_serial_dates(spark):
    got = column(spark, ["45678", "45678.0", "12345", "4567", "x"], lambda c: s.excel_serial_date(c, F.lit(dt.date(2025, 1, 1))))
    assert got == [dt.date(2025, 1, 21), dt.date(2025, 1, 21), None, None, None]


@pytest.mark.parametrize("name, want", [("Invoice Number(s)", "invoice_number_s"), ("postDate", "post_date"), (" YTD  EXPENDED ", "ytd_expended"),
                                        ("% Used", "used"), ("PO #", "po"), ("a__b", "a_b")])
def test_snake_case(spark, name, want):
    assert s.snake_case(name) == want
    assert column(spark, [name], s.snake_case_col) == [want]


def test_names_and_masks(spark):
    assert column(spark, ["Acme Supply, LLC", "Delta Co Inc", "Inca Corp"], s.strip_legal_suffix) == ["acme supply", "delta", "inca"]
    assert column(spark, ["Acme Supply LLC", "Delta Co. Inc", "Llc Partners"], s.strip_trailing_suffix) == ["acme supply", "delta", "llc partners"]
    assert column(spark, ["123-45-6789", "abc", "a@b.co", "x"], s.mask_preview) == ["***-**-6789", "**c", "*@b.co", "*"]
    assert column(spark, ["Café-Bar!  Ltd"], s.search_text) == ["cafe-bar ltd"]
    assert column(spark, ["A.B_c!", None], s.match_text) == ["a b_c", ""]


def test_year_period_and_vendor(spark):
    df = spark.createDataFrame([("2026/03",), ("26/03",), ("*75/12",), ("",)], "v string").select(*s.split_year_period("v"))
    assert [tuple(r) for r in df.collect()] == [("2026", "03", False), ("2026", "03", False), ("1975", "12", True), ("", "", False)]
    df = spark.createDataFrame([("1022 Valley Telecom",), ("7 - Acme",), ("Acme",)], "v string").select(*s.split_vendor("v"))
    assert [tuple(r) for r in df.collect()] == [(True, "1022", "Valley Telecom"), (True, "7", "Acme"), (False, "", "")]


def test_comparisons(spark):
    df = spark.createDataFrame([(1.0, -1.0), (1.0, None), (2.0, 2.5)], "a double, b double")
    got = df.select(s.amounts_match(F.col("a"), F.col("b")), s.signed_equal(F.col("a"), F.col("b")), s.amounts_match(F.col("a"), F.col("b"), 0.5)).collect()
    assert [tuple(r) for r in got] == [(False, True, False), (False, False, False), (False, False, True)]
    df = spark.createDataFrame([(Decimal("5.00"), None), (None, None), (Decimal("1"), Decimal("3"))], "d decimal(18,2), c decimal(18,2)")
    assert [r[0] for r in df.select(s.signed_amount(F.col("d"), F.col("c"))).collect()] == [Decimal("5.00"), None, Decimal("-2.00")]
