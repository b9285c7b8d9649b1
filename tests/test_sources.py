import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.operators import runs
from tieout.sources import datasets, exports, files
from tieout.streaming import audit


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_export_and_manifest(spark, tmp_path):
    write(tmp_path / "in/a.csv", "﻿Code,Name\n007,\"Smith, J\"\n,\n 1 ,x\n")
    write(tmp_path / "in/b.csv", "Code,Name\n9,z\n")
    df = exports.read_export(spark, str(tmp_path / "in"))
    rows = sorted((r.source_file[-5:], r.source_row_index, r.Code, r.Name) for r in df.collect())
    assert rows == [("a.csv", 0, "007", "Smith, J"), ("a.csv", 1, "", ""), ("a.csv", 2, " 1 ", "x"), ("b.csv", 0, "9", "z")]
    got = {r.file_name: (r.n_rows, r.n_columns) for r in files.input_manifest(spark, str(tmp_path / "in"), df).collect()}
    assert got == {"a.csv": (3, 2), "b.csv": (1, 2)}


def test_row_index_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big/x.csv", "n\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = exports.read_export(spark, path)
        assert df.where("cast(n as bigint) <> source_row_index").count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_title_blocks(spark, tmp_path):
    write(tmp_path / "t/a.csv", "City\nBUDGET REPORT\n\nFund,Org,\"YTD, ACTUAL\"\n1,10,5\n2,20,6\n")
    write(tmp_path / "t/b.csv", "1,10,5\n2,20,6\n")
    write(tmp_path / "t/c.csv", "As of,2026-01-01\nFund,Org\n")
    top = exports.top_lines(spark, str(tmp_path / "t"))
    assert {r.source_file[-5:]: r.header_row for r in exports.skip_title_block(top).collect()} == {"a.csv": 3, "b.csv": 0, "c.csv": 0}
    got = exports.read_titled_export(spark, str(tmp_path / "t/a.csv")).drop("source_file").orderBy("source_row_index").collect()
    assert [r.asDict() for r in got] == [{"Fund": "1", "Org": "10", "YTD, ACTUAL": "5", "source_row_index": 0}, {"Fund": "2", "Org": "20", "YTD, ACTUAL": "6", "source_row_index": 1}]
    write(tmp_path / "h/v.csv", "Report,2026\nVend No,Vendor Name,Vendor Status,Phone Number\n1,Acme,Active,5\n")
    best = exports.header_row_by_overlap(exports.top_lines(spark, str(tmp_path / "h"))).head()
    assert (best.header_row, best.score) == (1, 0.825)


def test_header_resolution():
    spec = datasets.DATASETS
    assert datasets.resolve(["Vendor No", "Inv #", "INVOICE NET", "Net Amount"], spec["ap_invoice_detail"])["Vendor No"] == "vendor_number"
    assert datasets.resolve(["Post Date", "Eff Date"], spec["gl_detail"]) == {"Post Date": "date", "Eff Date": "eff_date"}
    assert datasets.resolve(["amount", "INVOICE NET"], spec["ap_invoice_detail"]) == {"amount": "amount", "INVOICE NET": "invoice_amount"}
    assert datasets.resolve(["Type", "Check Status"], spec["check_register"]) == {"Type": "type", "Check Status": "status"}
    assert datasets.resolve(["Type"], spec["check_register"]) == {"Type": "status"}
    assert all(len(d.columns) == len(set(d.columns)) for d in spec.values())


def test_detection(spark):
    rows = [(d.name, c.replace("_", " ").title()) for d in datasets.DATASETS.values() for c in d.columns] + [("odd", "Foo"), ("odd", "Bar")]
    got = exports.detect_dataset_type(spark.createDataFrame(rows, "file_id string, header string")).collect()
    assert {r.file_id: r.dataset_type for r in got} == {**{n: n for n in datasets.DATASETS}, "odd": None}


def test_normalize(spark):
    rows = [(0, "1022 Valley Telecom", "A1", "01/15/2026", "$1,200.00"), (1, "1023 - Acme", "A2", "45678", "(5.00)"),
            (3, "", "", "", "1195.00"), (4, "1024 Beta", "A3", "soon", "x")]
    df = spark.createDataFrame(rows, "source_row_index int, Vendor string, `Inv No` string, `Inv Date` string, `Gross Amount` string")
    with pytest.raises(ValueError):
        exports.normalize_export(df, "purchase_orders")
    typed, rejects, warnings = exports.normalize_export(df, "ap_invoice_detail", as_of=dt.date(2026, 1, 1))
    got = {r.source_row_index: (r.vendor_number, r.vendor_name, r.invoice_date, r.invoice_amount) for r in typed.collect()}
    assert sorted((r.source_row_index, r.code) for r in warnings.collect()) == [(1, "excel_serial_dates:invoice_date"), (3, "footer_total_rows")]
    assert got[0][2:] == (dt.date(2026, 1, 15), Decimal("1200.0000")) and got[1][2:] == (dt.date(2025, 1, 21), Decimal("-5.0000"))
    assert {(r.source_row_index, r.column) for r in rejects.collect()} == {(4, "invoice_date"), (4, "invoice_amount")}
    with pytest.raises(ValueError):
        exports.require_clean(rejects)
    gl = spark.createDataFrame([(0, "*26/03", "J1", "2026-03-01", "1", "10", "500", "x", "-40.00")],
                               "source_row_index int, `YR/PR` string, JNL string, `Eff Date` string, Fund string, Org string, Object string, Desc string, Amount string")
    typed, rejects, warnings = exports.normalize_export(gl, "gl_detail")
    r = typed.head()
    assert (r.fiscal_year, r.period, r.unposted, r.debit, r.credit) == ("2026", "03", True, None, Decimal("40.0000"))
    assert [w.code for w in warnings.collect()] == ["unposted_journals"] and rejects.isEmpty()


def test_accounts_and_context(spark, tmp_path):
    chart = spark.createDataFrame([(0, "100", "Cash"), (1, " ", "x"), (2, "100", "Cash 2")], "source_row_index int, Account string, Description string")
    assert [tuple(r) for r in exports.accounts_reference(chart).collect()] == [("100", "Cash 2")]
    write(tmp_path / "ctx/a.md", "hello\nworld")
    write(tmp_path / "ctx/sub/b.txt", "x" * 30)
    write(tmp_path / "ctx/c.bin", "no")
    got = {r.name: r.text for r in exports.text_context(spark, str(tmp_path / "ctx")).collect()}
    assert got == {"a.md": "hello\nworld", "sub/b.txt": "x" * 30}


def test_write_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": "v"})], "id int, xs array<string>, m map<string,string>")
    path = files.write_results(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(path).head()
    assert (back.id, back.xs) == ("1", '["a"]')
    assert files.output_manifest(spark, path).count() >= 1
    cols = "run_id bigint, ts timestamp_ntz, seq bigint, action string"
    src, out, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    for i in range(3):
        spark.createDataFrame([(1, dt.datetime(2026, 1, 3 - i), i, f"a{i}")], cols).coalesce(1).write.mode("append").parquet(src)
        audit.audit_append(spark, src, out, state)
    audit.audit_append(spark, src, out, state)
    assert [r.seq for r in audit.audit_trail(spark, out, 1).collect()] == [2, 1, 0]


def test_scale_out(spark):
    df = spark.createDataFrame([("A1; B2", dt.date(2026, 1, 1), Decimal("10.00"), "V")], "ids string, d date, amount decimal(18,2), vendor string")
    got = runs.scale_out(df, 122, ["d"], ["amount"], ["ids"]).orderBy("copy_no").collect()
    assert tuple(got[0])[:4] == ("A1; B2", dt.date(2026, 1, 1), Decimal("10.00"), "V")
    assert tuple(got[121])[:4] == ("A1-121; B2-121", dt.date(2026, 1, 31), Decimal("54.77"), "V")


# -- records over lines and splits


def by_csv(text):
    """Records as Python's reader sees them, with blank lines left out."""
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def messy(rng, n):
    """Cells with delimiters, breaks, doubled, stray and trailing quotes."""
    cell = lambda: rng.choice(["", "1", "a b", '"x,y"', '"two\nlines"', '"a\n\n\nb"', '"say ""hi"""', '""', '"""', '5" pipe', 'a"b"c', '"q"tail', '"q"t"ail', " ", "é中"])
    rows = []
    for i in range(n):
        row = [str(i), *[cell() for _ in range(3)]]
        if '"""' in row:  # opens a cell that begins with a quote: it is closed further on
            row = [str(i), '"""open', 'still"', "x"]
        rows.append(",".join(row))
        if rng.random() < 0.05:
            rows.append("")
    return "id,a,b,c\n" + "\n".join(rows) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", ["134217728", "4000", "300", "70"])
def test_records_against_the_plain_reader(spark, tmp_path, size):
    rng = random.Random(int(size))
    texts = {f"f{i}.csv": messy(rng, 120) for i in range(3)}
    texts["crlf.csv"] = '\ufeffid,a,b,c\r\n1,"x\r\ny",2,3\r\n\r\n2,,"",z\r\n'
    texts["long.csv"] = "id,a,b,c\n1," + '"' + "line\n" * 400 + '",x,y\n2,p,q,r\n'
    texts["open.csv"] = 'id,a,b,c\n1,2,3,4\n5,"never closed\n6,7,8'
    for name, text in texts.items():
        write(tmp_path / "in" / name, text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = exports.read_export(spark, str(tmp_path / "in")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        want = [(*(r + [""] * 4)[:4], i) for i, r in enumerate(by_csv(text.lstrip("\ufeff").replace("\r\n", "\n"))[1:])]
        mine = sorted(((r.id, r.a, r.b, r.c, r.source_row_index) for r in got if r.source_file.endswith("/" + name)), key=lambda r: r[4])
        assert [m[4] for m in mine] == [w[4] for w in want], name
        for m, w in zip(mine, want):
            # Spark's cell parser keeps the quotes of a cell that goes on behind its closing quote
            assert [str(c).replace('"q"t', "qt") for c in m] == list(map(str, w)), name


def test_files_with_their_own_headers_in_one_plan(spark, tmp_path):
    write(tmp_path / "in/a.csv", 'Code,"Long\nName",Code\n1,x,2\n')
    write(tmp_path / "in/b.csv", '\ufeff"Code","Note"\n7,"n\nn"\n')
    write(tmp_path / "in/c.csv", "Note,,Code\nz,blank,9\n")
    df = exports.read_export(spark, str(tmp_path / "in"))
    rows = sorted((r.source_file[-5:], r.Code, r["Long\nName"], r["Code.1"], r.Note, r["_c1"]) for r in df.collect())
    assert rows == [("a.csv", "1", "x", "2", "", ""), ("b.csv", "7", "", "", "n\nn", ""), ("c.csv", "9", "", "", "z", "blank")]
    assert exports.read_export(spark, write(tmp_path / "e/empty.csv", "")).count() == 0
    assert exports.read_export(spark, write(tmp_path / "o/only.csv", "a,b\n")).columns[:2] == ["a", "b"]


def test_title_block_above_records_with_breaks(spark, tmp_path):
    path = write(tmp_path / "t/a.csv", 'City,\n"BUDGET\nREPORT"\n\nFund,"Org\nname",\n1,"x\ny",5\n\n2,20,6\n')
    got = exports.read_titled_export(spark, path).orderBy("source_row_index").collect()
    assert [(r.Fund, r["Org\nname"], r.unnamed_2, r.source_row_index) for r in got] == [("1", "x\ny", "5", 0), ("2", "20", "6", 1)]


# -- status over the stream


def test_run_status_over_the_stream(spark, tmp_path):
    rng = random.Random(4)
    cols = "run_id bigint, ts timestamp_ntz, seq bigint, action string"
    actions = ["created", "add_note", "mark_reviewed", "needs_follow_up", "approve_draft", "reject_ai_explanation"]
    events = [(rng.randrange(9), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(200)), i, rng.choice(actions[: 3 + i % 4])) for i in range(160)]
    rng.shuffle(events)  # late ones too
    src, out, state = (str(tmp_path / n) for n in ("src", "status", "state"))
    batch = lambda rows: runs.run_status(spark.createDataFrame(rows, cols)).collect()
    for i in range(3):  # three micro-batches, a restart before each
        spark.createDataFrame(events[i * 40 : i * 40 + 40], cols).coalesce(1).write.mode("append").parquet(src)
        audit.follow_run_status(spark, src, out, state)
        assert sorted(audit.current_run_status(spark, out).collect()) == sorted(batch(events[: i * 40 + 40]))
    audit.follow_run_status(spark, src, out, state)  # nothing new
    audit.fold_run_status(spark, out)
    assert sorted(audit.current_run_status(spark, out).collect()) == sorted(batch(events[:120]))
    assert len([p for p in (tmp_path / "status").iterdir() if p.name.startswith("batch=")]) == 1
    spark.createDataFrame(events[120:], cols).repartition(4).write.mode("append").parquet(src)
    audit.follow_run_status(spark, src, out, state, files_per_batch=1)
    assert sorted(audit.current_run_status(spark, out).collect()) == sorted(batch(events))
