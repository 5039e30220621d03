import json

from pyspark.sql import functions as F

from fieldtrust.operators import importers as imp
from fieldtrust.schemas import INVOICE_LABEL_DDL
from fieldtrust.sources import readers, writers

RAW = {
    "invoice_no": "51109301", "date_of_issue": "05/03/2024",
    "seller": {"name": "Acme", "gstin": "27X", "address": "1 Main St\nMumbai"}, "client": {"name": "Beta"},
    "items": [{"description": "Widget, \"A\"", "quantity": "2", "net_price": "1,000.50", "net_worth": "2,001.00"}],
    "summary": {"net_worth": "2,001.00", "vat_amount": "360.18", "gross_worth": "2,361.18", "total_gross_worth": "INR 2,361.18"},
}


def csv_cell(text):
    return '"' + text.replace('"', '""') + '"'


def test_invoice_batch(spark, tmp_path):
    broken_amount = json.loads(json.dumps(RAW))
    broken_amount["items"][0]["quantity"] = "many"
    sparse = {"invoice_no": "", "date_of_issue": "2024", "summary": {"total_gross_worth": "12"}}
    rows = [("a.pdf", json.dumps(RAW, indent=1)), ("b.pdf", "{oops"), ("c.pdf", json.dumps(broken_amount)), ("d.pdf", json.dumps(sparse))]
    lines = ["filename,json_data,ocred_text"]
    lines += [",".join([name, csv_cell(text), csv_cell("page 1\n\"page\" 2")]) for name, text in rows]
    path = tmp_path / "batch.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    labels = imp.invoice_labels(readers.read_invoice_batch(spark, str(path)), labeled_at="2024-06-01")
    failed = {r["filename"]: r["row_error"] for r in imp.failed_rows(labels).collect()}
    assert failed == {"b.pdf": "invalid JSON", "c.pdf": "bad item amount"}
    good = {r["filename"]: r for r in imp.good_rows(labels).collect()}
    a, d = good["a.pdf"], good["d.pdf"]
    assert (a["invoice_number"], a["invoice_date"], a["currency"]) == ("51109301", "2024-03-05", "INR")
    assert (a["subtotal"], a["tax"]["total_tax"], a["total_amount"]) == (2001.0, 360.18, 2361.18)
    assert a["line_items"][0].asDict() == {
        "description": 'Widget, "A"', "hsn_sac": None, "quantity": 2.0, "unit_price": 1000.5, "line_total": 2001.0,
    }
    assert a["_meta"]["doc_file"] == "a.pdf" and a["_meta"]["doc_type"] is None
    assert (d["invoice_date"], d["currency"], d["subtotal"], d["vendor_name"], d["line_items"]) == (None, "INR", None, None, [])
    tally = {r["outcome"]: r["n"] for r in imp.import_tally(labels).collect()}
    assert tally == {"written": 2, "failed": 2}


def test_statement_batch(spark, tmp_path):
    one = {"date": "2023-05-09 08:15:00", "value_date": "2023-05-09", "description": "Rent for May", "cheque_no": "330018",
           "debit": 1450.75, "credit": None, "balance": 8820.2}
    credit = {"date": "11/05/2023", "value_date": "11/05/2023", "description": "Refund", "cheque_no": "-", "cr_dr": "CR",
              "transaction_amount": 312.4, "available_balance": 77001.6}
    debit = {**credit, "cr_dr": "DR", "value_date": ""}
    head = {"bank_name": "B", "account_holder": "H", "account_number": "123456789012", "ifsc_code": "I", "currency": "INR",
            "opening_balance": 1.0, "closing_balance": 2.0, "start_date": "2024-01-01", "end_date": "2024-03-31"}
    for sub, name, body in [
        ("Digital_Type1", "00001", json.dumps({**head, "transactions": [one]}, indent=2)),
        ("Digital_Type2", "00002", json.dumps({**head, "transactions": [credit, debit]})),
        ("Digital_Type2", "00003", json.dumps({**head, "transactions": []})),
        ("Digital_Type2", "00004", "[1,"),
        ("Digital_Type2", "00005", json.dumps({**head, "transactions": [{**credit, "value_date": "a/b/2024"}]})),
    ]:
        folder = tmp_path / sub
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(body, encoding="utf-8")
    labels = imp.statement_labels(readers.read_statement_batch(spark, str(tmp_path)))
    good = {r["doc_file"]: r for r in imp.good_rows(labels).collect()}
    assert set(good) == {f"bankstmt_digital_type{t}_0000{n}.pdf" for t, n in ((1, 1), (2, 2), (2, 3))}
    assert {r["doc_file"][-9:-4] for r in imp.failed_rows(labels, "doc_file").collect()} == {"00004", "00005"}
    first = good["bankstmt_digital_type1_00001.pdf"]
    assert tuple(first["transactions"][0]) == ("2023-05-09", "Rent for May", 1450.75, None, 8820.2, "330018")
    assert first["statement_period"]["end"] == "2024-03-31" and first["_meta"]["doc_type"] == "bank_statement"
    cr, dr = good["bankstmt_digital_type2_00002.pdf"]["transactions"]
    assert tuple(cr) == ("2023-05-11", "Refund", None, 312.4, 77001.6, None)
    # An empty value date falls back to the date.
    assert (dr["date"], dr["debit"], dr["credit"]) == ("2023-05-11", 312.4, None)
    assert good["bankstmt_digital_type2_00003.pdf"]["transactions"] == []


def test_label_scan(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"_meta": {"doc_file": "x.pdf"}, "subtotal": 1.5, "tax": {"total_tax": 2}}, indent=2))
    (tmp_path / "two words.json").write_text(json.dumps({"invoice_number": "7"}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "note.txt").write_text("{}")
    labels, skipped = readers.scan_labels(spark, str(tmp_path))
    assert {(r["doc_name"], r["subtotal"]) for r in labels.collect()} == {("x.pdf", 1.5), ("two words.pdf", None)}
    assert [r["label_path"].rsplit("/", 1)[-1] for r in skipped.collect()] == ["bad.json"]
    listing = spark.createDataFrame([("x.pdf",)], "doc_name string")
    usable, missing = readers.with_documents(labels, listing)
    assert [r["doc_name"] for r in usable.collect()] == ["x.pdf"]
    assert [tuple(r) for r in missing.collect()] == [("two words.pdf", "document not found")]


def test_label_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"_meta": {"doc_file": "a.pdf"}, "subtotal": 1.5}))
    labels, _ = readers.scan_labels(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writers.write_labels(labels.drop("doc_name", "label_path"), out)
    back = spark.read.schema(INVOICE_LABEL_DDL).json(f"{out}/doc_type=invoice")
    assert back.first()["subtotal"] == 1.5


def test_intake(spark, tmp_path):
    # Files of zero bytes are not part of a scan.
    for name, size in [("a.pdf", 3), ("b.PNG", 2), ("c.exe", 1), ("d.tiff", 0), ("noext", 1)]:
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {r["doc_name"]: (r["suffix"], r["ok"]) for r in readers.intake(readers.document_listing(spark, str(tmp_path))).collect()}
    assert rows == {"a.pdf": (".pdf", True), "b.PNG": (".png", True), "c.exe": (".exe", False), "noext": ("", False)}
    pages = spark.createDataFrame([("x/a.pdf", 0), ("x/b.pdf", None)], "path string, length bigint")
    assert {r["error"] for r in readers.intake(pages).collect()} == {"document has no pages"}
    narrow = readers.intake(readers.document_listing(spark, str(tmp_path)), readers.UPLOAD_SUFFIXES)
    assert {r["doc_name"] for r in narrow.filter("ok").collect()} == {"a.pdf", "b.PNG"}


def test_read_or_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    assert readers.read_or_empty(spark, path, "a int").collect() == []
    spark.range(3).select(F.col("id").cast("int").alias("a")).write.parquet(path)
    assert readers.read_or_empty(spark, path, "a int").count() == 3


def test_report_sink_replaces_its_section(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = lambda section, v: spark.createDataFrame([("m", v, section)], "metric string, value double, section string")
    writers.write_report(rows("a", 1.0).union(rows("b", 1.0)), path)
    writers.write_report(rows("a", 2.0), path)
    assert {(r["section"], r["value"]) for r in spark.read.parquet(path).collect()} == {("a", 2.0), ("b", 1.0)}


def test_batch_files_have_a_bound(spark, tmp_path, monkeypatch):
    """A file with values of several lines is one task's work, so a batch is many files."""
    import datetime
    import os

    from fieldtrust.catalog import imports

    day = datetime.datetime(2020, 3, 1)
    rows = [(i, i % 5, i % 3, 1, 2.0, 10.5 + i, day) for i in range(60)]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    batch = tmp_path / "batch"
    monkeypatch.setattr(imports, "fresh_path", lambda spark, name: f"file://{batch}")
    monkeypatch.setattr(imports, "BATCH_ROWS", 10, raising=False)
    got = sorted(map(tuple, imports.invoice_batch_csv(spark, str(tmp_path)).collect()), key=str)
    assert len([f for f in os.listdir(batch) if f.endswith(".csv")]) >= 6
    assert got == sorted(map(tuple, imports.import_invoices(spark, str(tmp_path)).collect()), key=str)


def test_large_batches_are_packed(spark, tmp_path, monkeypatch):
    import datetime
    import os

    from fieldtrust.catalog import imports

    day = datetime.datetime(2020, 3, 1)
    rows = [(i, i % 5, i % 3, 1, 2.0, 10.5 + i, day) for i in range(600)]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got, size, names = {}, {}, {}
    for most in (600, 599):
        batch = tmp_path / f"batch-{most}"
        monkeypatch.setattr(imports, "fresh_path", lambda spark, name: f"file://{batch}")
        monkeypatch.setattr(imports, "BATCH_ROWS", 100)
        monkeypatch.setattr(imports, "PLAIN_ROWS", most, raising=False)
        got[most] = sorted(map(tuple, imports.invoice_batch_csv(spark, str(tmp_path)).collect()), key=str)
        names[most] = [f for f in os.listdir(batch) if f.startswith("part-")]
        size[most] = sum(os.path.getsize(batch / f) for f in names[most])
    assert all(f.endswith(".csv") for f in names[600]) and all(f.endswith(".csv.gz") for f in names[599])
    assert len(names[599]) >= 6 and 5 * size[599] < size[600]
    assert got[599] == got[600] == sorted(map(tuple, imports.import_invoices(spark, str(tmp_path)).collect()), key=str)


def test_label_files_are_packed(spark, tmp_path, monkeypatch):
    import datetime
    import os

    from fieldtrust.catalog import imports

    day = datetime.datetime(2020, 3, 1)
    rows = [(i, i % 5, i % 3, i % 4 + 1, 2.0, 10.0 + i, day) for i in range(600)]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    path = tmp_path / "labels"
    monkeypatch.setattr(imports, "fresh_path", lambda spark, name: f"file://{path}")
    monkeypatch.setattr(imports.writers, "PACKED_ROWS", 100)
    got = {r["kind"]: (r["n"], r["subtotal"]) for r in imports.label_files(spark, str(tmp_path)).collect()}
    good = [r for r in rows if r[0] % 17 and r[0] % 23]
    labels = [r for r in good if r[3] != 3]
    assert got == {"label": (len(labels), sum(r[5] for r in labels)), "skipped": (len(good) - len(labels), None)}
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert all(f.endswith(".txt.gz") for f in files) and len(files) == -(-len(good) // 100)


def test_packed_label_files_are_documents(spark, tmp_path):
    """What a codec adds to a file's name is no part of the document's name."""
    import gzip

    (tmp_path / "one two.json.gz").write_bytes(gzip.compress(json.dumps({"subtotal": 1.5}).encode()))
    (tmp_path / "bad.json.gz").write_bytes(gzip.compress(b"{"))
    labels, skipped = readers.scan_labels(spark, str(tmp_path), glob="*.json.gz")
    assert [(r["doc_name"], r["subtotal"]) for r in labels.collect()] == [("one two.pdf", 1.5)]
    assert skipped.count() == 1


def test_packed_labels(spark, tmp_path):
    import glob

    from fieldtrust.sources.writers import write_labels

    labels = spark.createDataFrame([("invoice", f"INV-{i}", 1.5 * i) for i in range(2000)], "kind string, invoice_number string, subtotal double")
    labels = labels.select(F.struct(F.col("kind").alias("doc_type")).alias("_meta"), "invoice_number", "subtotal")
    sizes = {}
    for codec in (None, "gzip"):
        path = str(tmp_path / str(codec))
        write_labels(labels, path, compression=codec)
        sizes[codec] = sum(len(open(f, "rb").read()) for f in glob.glob(f"{path}/doc_type=invoice/part-*"))
        back = spark.read.schema("invoice_number string, subtotal double").json(f"{path}/doc_type=invoice")
        assert sorted(map(tuple, back.collect())) == sorted((f"INV-{i}", 1.5 * i) for i in range(2000))
    assert 3 * sizes["gzip"] < sizes[None]
