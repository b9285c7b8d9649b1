"""Large inputs: how much a step copies, and that it still finds everything."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tieout.operators import bands, findings, po, texts
from tieout.session import spread


def test_band_join_copies_little_and_loses_no_pair(spark):
    rng = random.Random(3)
    rows = [(i, Decimal(rng.randrange(-4000, 4000)) / 100, rng.randrange(-90, 90)) for i in range(300)]
    a = spark.createDataFrame(rows, "a int, x decimal(18,2), d int")
    b = a.toDF("b", "y", "e")
    copies = F.size(bands.buckets_in_reach(F.col("y"), Decimal("0.05"), F.lit(Decimal("0.05"))))
    assert b.agg(F.avg(copies)).head()[0] < 2
    got = bands.band_join(a, b, [], [bands.Band("x", "y", Decimal("0.05")), bands.Band("d", "e", 7)])
    want = sorted((i, j) for i, x, d in rows for j, y, e in rows if abs(x - y) <= Decimal("0.05") and abs(d - e) <= 7)
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_only_rows_without_their_quantity_meet_the_first_line(spark):
    inv = spark.createDataFrame([(1, "P1", "I1", 5, 2.0), (2, "P1", "I2", 9, 2.0), (3, "P2", "I3", 5, 2.0), (4, None, "I4", 5, 2.0)],
                                "row_id int, po_number string, invoice_number string, qty int, unit_price double")
    lines = spark.createDataFrame([(11, "P1", "1", 7, 1.0), (12, "P1", "2", 5, 1.5), (13, "P1", "3", 5, 1.7), (None, "P1", "0", 9, 1.9)],
                                  "row_id int, po_number string, line string, qty int, unit_price double")
    best = po.best_po_line(inv, lines)
    assert {(r.row_id, r.po_row, r.po_line) for r in best.collect()} == {(1, 12, "2"), (2, 11, "1")}
    assert "isnull(best" in best._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_skipped_only_where_they_cannot_match(spark):
    said = ["see gl:12 at 10:30 pm", "ROWS 3, 4 and 5", "on 2024-01-05 and 2024/02/06 or 3/4/24", "June 5th, 2023; 7 AUG 2022; Sept 2021; May 9; 3 Dec",
            "the 4TH time", "Finding 3 of $5.00", "a 30-day limit, INV-77", "twenty-two of 40%", ""]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    got = texts.extract_claims(docs)
    # each pattern that needs some letters finds nothing in texts without them
    for i, need in texts._NEEDS.items():
        assert docs.where(F.col("text").rlike(texts.CLAIM_PATTERNS[i][1]) & ~F.lower("text").rlike(need)).count() == 0
    assert {(r.doc_id, r.value) for r in got.where("kind in ('date', 'month', 'monthday', 'ref', 'row')").collect()} == {
        (0, "gl:12"), (1, "3"), (1, "4"), (1, "5"), (2, "2024-01-05"), (2, "2024-02-06"), (2, "2024-03-04"), (3, "2023-06-05"), (3, "2022-08-07"),
        (3, "2021-09"), (3, "05-09"), (3, "12-03")}


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert spread(rows, 10).rdd.getNumPartitions() == 100
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_evidence_is_looked_up_once_and_by_cell(spark):
    found = spark.createDataFrame([("f1", {"a": "10.00", "b": "x"}), ("f1", {"a": None}), ("f2", {"a": "3"}), (None, {"a": "3"})], "finding_id string, computed_values map<string,string>")
    cells = spark.createDataFrame([("f1", "ap", "1", "amt", "$10"), ("f1", "ap", "1", "who", "y"), ("f1", "ap", "1", "who", "x"), ("f2", "ap", "2", "amt", "4"),
                                   (None, "ap", "3", "amt", "3"), ("f2", "ap", None, "amt", "3"), ("f2", "gl", "1", "amt", None)],
                                  "finding_id string, table_name string, row_id string, column_name string, cell string")
    files = spark.createDataFrame([("ap", "ap.csv", "h")], "table_name string, file_name string, sha256 string")
    got = findings.source_evidence(found, cells, files)
    assert sorted(((r.finding_id, r.row_id, r.cell, r.highlighted, r.file_name) for r in got.collect()), key=str) == sorted([
        ("f1", "1", "$10", True, "ap.csv"), ("f1", "1", "y", True, "ap.csv"), ("f1", "1", "x", True, "ap.csv"), ("f2", "2", "4", False, "ap.csv"),
        (None, "3", "3", False, "ap.csv"), ("f2", None, "3", False, "ap.csv"), ("f2", "1", None, False, None)], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
