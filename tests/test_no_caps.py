"""Answers that must not depend on lengths, counts or the shape of a file."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators import ap, criteria, findings, search, texts
from tieout.sources import exports


@pytest.fixture(scope="module")
def transactions(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcl x") for _ in range(rng.randint(1, 7))).strip() or "a" for _ in range(60)] + ["alpha", "l", "ab", "axb"]
    numbers = ("invoice_number", "po_number", "check_number", "fund", "department", "object_code")
    rows = spark.createDataFrame([(i, "gl_detail", n, dt.date(2024, 1, 1 + i % 20), i, "t " + n) for i, n in enumerate(names)],
                                 "row_id long, module string, vendor_name string, txn_date date, amount decimal(18,2), text string"
                                 .replace("decimal(18,2)", "long"))
    return rows.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumns({c: F.lit(None).cast("string") for c in numbers})


@pytest.mark.parametrize("ratio", [0.9, 0.7, None])
def test_batch_search_is_the_union_of_single_searches(spark, transactions, ratio):
    asked = ["l", "ab", "a", "lph", "alphabet", "axb", "xx", "c x"]
    found = search.batch_search(spark.createDataFrame([(a, a) for a in asked], "query_id string, vendor string"), transactions, ratio)
    want = {(a, r.row_id) for a in asked for r in search.search_vendor(transactions, a, ratio).collect()}
    assert {(r.query_id, r.row_id) for r in found.collect()} == want


def test_empty_searches(transactions):
    assert search.search_vendor(transactions, " ").count() == 0
    assert search.search_keywords(transactions, []).count() == transactions.count()


@pytest.mark.parametrize("ratio,pairs", [(0.79, 1), (0.9, 0)])
def test_similar_names_do_not_depend_on_crowding(spark, ratio, pairs):
    rows = spark.createDataFrame([("1", "V1", "i1", "ab"), ("2", "V2", "i2", "axb")], "row_id string, vendor_number string, invoice_number string, vendor_name string")
    rows = rows.withColumns({"invoice_amount": F.lit("10.00").cast("decimal(18,2)"), "invoice_date": F.lit("2024-01-01").cast("date")})
    assert [ap.similar_vendor_same_amount(rows, min_ratio=ratio, crowded=c).count() for c in (512, 0)] == [pairs, pairs]


def test_all_keywords_are_kept(spark):
    words = ["alphaword", "bravoword", "charlieword", "deltaword", "echoword", "foxtrotword", "golfword", "hotelword", "indiaword", "romeoword", "kiloword", "limaword"]
    got = criteria.parse_search_criteria(spark.createDataFrame([(" ".join(words),)], "query string")).first()
    assert list(got.keywords) == words


def test_unknown_rule(spark):
    rows = spark.createDataFrame([("1",)], "row_id string")
    with pytest.raises(ValueError):
        findings.to_findings(rows, "no_such_rule", ["row_id"], [], F.lit("r"))
    got = findings.to_findings(rows, "missing_po", ["row_id"], [], F.lit("r")).first()
    assert len(got.finding_id) == 64


def test_numbers_keep_their_decimals(spark):
    docs = spark.createDataFrame([(1, "rate 1.123456789012 and $2.1234567891 million and 0.5 billion")], "doc_id long, text string")
    got = {r.raw.strip(): str(r.number.normalize()) for r in texts.extract_claims(docs).where("kind = 'number'").collect()}
    assert got["1.123456789012"] == "1.123456789012"
    assert got["$2.1234567891 million"] == "2123456.7891"
    assert float(got["0.5 billion"]) == 5e8


def test_header_names_with_accents(spark):
    name = "Número  Año"
    assert s.snake_case(name) == "número_año"
    assert spark.createDataFrame([(name,)], "h string").select(s.snake_case_col("h").alias("h")).first().h == "número_año"


def test_blank_header_cell_keeps_its_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\nCode,,Amount\nA1,x,10.00\n")
    got = exports.read_titled_export(spark, f"file://{tmp_path}").drop("source_file", "source_row_index").first().asDict()
    assert got == {"Code": "A1", "unnamed_1": "x", "Amount": "10.00"}


def test_files_with_their_own_header_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PO Number,Amount\n1,10.00\n")
    (tmp_path / "b.csv").write_text("Amount,PO Number\n99.00,2\n")
    rows = exports.read_export(spark, f"file://{tmp_path}").select("`PO Number`", "Amount").collect()
    assert sorted(map(tuple, rows)) == [("1", "10.00"), ("2", "99.00")]


def test_header_below_a_long_title(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"Title line {i}\n" for i in range(12)) + "Code,Amount\nA1,10.00\n")
    got = exports.read_titled_export(spark, f"file://{tmp_path}", title_rows=20).drop("source_file", "source_row_index").collect()
    assert [r.asDict() for r in got] == [{"Code": "A1", "Amount": "10.00"}]


def test_shared_order_number_header_counts(spark):
    from tieout.sources import datasets

    spec = datasets.DATASETS["purchase_orders"]
    scores = []
    for first in ("po_number", "Purchase Order"):
        headers = [first, *[c for c in spec.required if c != "po_number"]]
        files = spark.createDataFrame([("f", h) for h in headers], "file_id string, header string")
        scores.append(exports.header_scores(files, ["file_id"]).where("dataset_type = 'purchase_orders'").first().score)
    assert scores[0] == scores[1]
