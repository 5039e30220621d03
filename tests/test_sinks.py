"""Ordered files, file inspection, drafts and the exemplar folder."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrust.functions.fields import field_struct
from fieldtrust.operators.exemplars import ExemplarIndex
from fieldtrust.operators.pruned import top_k_pruned
from fieldtrust.operators.retrieval import letter_profile
from fieldtrust.plans import documents as plan
from fieldtrust.schemas import INVOICE_LABEL_DDL
from fieldtrust.sources.readers import document_contents, inspected, read_ordered, scan_labels
from fieldtrust.sources.writers import write_ordered


def test_ordered_rows_keep_their_positions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(5)
    order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
    for _ in range(2):  # a re-run replaces the files
        write_ordered(df, str(tmp_path / "r"), order, partitions=7)
    got = {r["position"]: (r["v"], r["i"]) for r in read_ordered(spark, str(tmp_path / "r")).collect()}
    assert [got[p] for p in range(2000)] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def test_ordered_empty_table(spark, tmp_path):
    write_ordered(spark.createDataFrame([], "v int"), str(tmp_path / "r"), ["v"])
    assert read_ordered(spark, str(tmp_path / "r")).count() == 0


FILES = {
    "a.pdf": (b"%PDF-1.4 /Type /Pages /Count 2 /Type/Page /Type /Page\n%%EOF", "pdf", 2, None),
    "tree.pdf": (b"%PDF-1.5 << /Type /Pages /Kids [] /Count 31 >> " + b"\x80\xff" * 3000 + b"%%EOF\r\n", "pdf", 31, None),
    "cut.pdf": (b"%PDF-1.4 /Type /Page " + b"x" * 3000, "pdf", 1, "document breaks off"),
    "early.pdf": (b"%PDF-1.4 /Type /Page %%EOF" + b"x" * 3000, "pdf", 1, "document breaks off"),
    "none.pdf": (b"%PDF-1.4 %%EOF", "pdf", 0, "document has no pages"),
    "b.png": (b"\x89PNG\r\n\x1a\n....", "png", 1, None),
    "c.JPG": (b"\xff\xd8\xff\xe0..", "jpeg", 1, None),
    "d.webp": (b"RIFF\x01\x02\x03\x04WEBPVP8 ", "webp", 1, None),
    "e.tif": (b"MM\x00*....", "tiff", 1, None),
    "f.bmp": (b"BM....", "bmp", 1, None),
    "g.jpg": (b"\x89PNG\r\n\x1a\n", "png", 1, "content is not what '.jpg' says"),
    "h.pdf": (b"hello", None, 0, "content is not what '.pdf' says"),
    "i.txt": (b"hello", None, 0, "cannot read files of type '.txt'"),
}


def test_files_are_told_by_their_bytes(spark, tmp_path):
    for name, (content, *_) in FILES.items():
        (tmp_path / name).write_bytes(content)
    got = {r["doc_name"]: r for r in inspected(document_contents(spark, str(tmp_path))).collect()}
    assert {n: (r["kind"], r["n_pages"], r["error"]) for n, r in got.items()} == {n: tuple(v[1:]) for n, v in FILES.items()}
    assert all(r["ok"] == (r["error"] is None) for r in got.values())


def test_missing_content(spark):
    df = spark.createDataFrame([("x/a.pdf", None), ("x/b.pdf", b"")], "path string, content binary")
    assert [r["error"] for r in inspected(df).collect()] == ["document has no pages"] * 2


TEXT = """Invoice No: 7
Seller: Acme
Description  HSN  Qty  Unit price  Amount
Blue widget  8471  2  1,250.00  2,500.00
Subtotal: 2,500.00
CGST: 1.00
SGST: 1.50
Total: INR 2,502.50"""


def test_drafts_are_labels(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", TEXT), ("b.pdf", ""), ("c.pdf", None)], "doc_name string, text string")
    drafts = plan.invoice_drafts(docs, labeled_at="2024-01-01")
    assert drafts.columns == [c.split()[0] for c in ("_meta x", *[f.name for f in drafts.schema.fields[1:]])]
    drafts.write.json(str(tmp_path / "d"))
    labels, skipped = scan_labels(spark, str(tmp_path / "d"), INVOICE_LABEL_DDL, multi_line=False)
    got = {r["doc_name"]: r for r in labels.collect()}
    assert skipped.count() == 0 and set(got) == {"a.pdf", "b.pdf", "c.pdf"}
    a = got["a.pdf"]
    assert (a["invoice_number"], a["subtotal"], a["total_amount"], tuple(a["tax"])) == ("7", 2500.0, 2502.5, (1.0, 1.5, None, 2.5))
    assert [tuple(i) for i in a["line_items"]] == [("Blue widget", "8471", 2.0, 1250.0, 2500.0)]
    assert a["_meta"]["labeled_by"] == "draft_from_extraction" and got["b.pdf"]["tax"] is None


def results(spark, rows):
    df = spark.createDataFrame(rows, "doc_name string, vendor string, ok boolean")
    field = lambda n, c, status: F.struct(*[F.when(status, F.lit("extracted")).otherwise(F.lit("abstained")).alias("status") if s == "status" else field_struct(n, c)[s].alias(s) for s in ("field", "value", "value_num", "confidence", "source_location", "status")])
    return df.select("doc_name", F.array(field("vendor_name", F.col("vendor"), F.col("ok"))).alias("fields"))


def test_exemplars_grow_by_run(spark, tmp_path):
    index = ExemplarIndex(spark, str(tmp_path / "x"), letter_profile, cell_rows=4)
    assert index.rows() is None and index.cells() is None
    first = results(spark, [(f"d{i}", "abcdefgh"[: i % 7 + 1], True) for i in range(30)] + [("bad", "x", False), ("blank", " ", True), ("null", None, True)])
    index.append(first, "r1")
    once = sorted(map(str, index.rows().collect()))
    index.append(first, "r1")
    assert sorted(map(str, index.rows().collect())) == once and len(once) == 30
    index.append(results(spark, [("d0", "zzz", True), ("new", "abc", True)]), "r2")
    rows = {r["id"]: r["layout_text"] for r in index.rows().collect()}
    assert len(rows) == 31 and rows["d0"] == "zzz" and rows["new"] == "abc"
    queries = letter_profile(spark.createDataFrame([("q", "invoice", "ccbbaa")], "query_id string, doc_type string, layout_text string"))
    near, _ = top_k_pruned(queries, index.cells(), 2)
    assert [rows[r["id"]] for r in near.orderBy("rank").collect()] == ["abc", "abc"]
    with pytest.raises(ValueError, match="run id"):
        index.append(first, "a/b")
