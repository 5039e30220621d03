from pyspark.sql import functions as F

from fieldtrust.operators import jobs as j
from fieldtrust.schemas import QUEUE_ITEM_DDL
from fieldtrust.session import fresh_path
from fieldtrust.streaming import jobs as stream

DDL = (
    "job_id string, event_type string, ord bigint, doc_name string, doc_type string, "
    f"queue array<{QUEUE_ITEM_DDL}>, error_message string, processing_time_s double"
)


def item(field, resolved=None):
    return (None, field, "v", 0.5, None, "abstained", resolved, None, None)


def log(spark):
    rows = [
        ("a", "doc_received", 1, "a.pdf", None, None, None, None),
        ("a", "extraction_started", 2, None, None, None, None, None),
        ("a", "extraction_done", 3, None, "invoice", [item("x"), item("y", True), item("x")], None, 1.0),
        ("a", "field_resolved", 9, None, None, None, None, None),
        ("b", "doc_received", 4, "b.pdf", None, None, None, None),
        ("b", "extraction_failed", 5, None, None, None, "boom", 3.0),
        ("c", "doc_received", 6, "c.pdf", None, None, None, None),
        # Never created: its events update nothing.
        ("ghost", "extraction_done", 7, None, "invoice", [item("z")], None, 100.0),
    ]
    return spark.createDataFrame(rows, DDL)


def test_view(spark):
    view = {r["job_id"]: r for r in j.job_view(log(spark)).collect()}
    assert {k: r["status"] for k, r in view.items()} == {"a": "done", "b": "failed", "c": "pending"}
    assert view["a"]["doc_type"] == "invoice" and view["a"]["doc_name"] == "a.pdf"
    assert view["b"]["error_message"] == "boom"
    assert j.job_by_id(j.job_view(log(spark)), "b").first()["status"] == "failed"


def test_later_null_keeps_the_value(spark):
    rows = [("a", "doc_received", 1, "d", None, None, None, None), ("a", "extraction_done", 2, None, "invoice", None, None, 2.0),
            ("a", "extraction_failed", 3, None, None, None, "late", None)]
    r = j.job_view(spark.createDataFrame(rows, DDL)).first()
    assert (r["status"], r["doc_type"], r["processing_time_s"]) == ("failed", "invoice", 2.0)


def test_stats(spark):
    got = {(r["metric"], r["key"]): r["value"] for r in j.job_stats(j.job_view(log(spark))).collect()}
    assert got == {
        ("total_jobs", None): 3.0, ("by_status", "done"): 1.0, ("by_status", "failed"): 1.0, ("by_status", "pending"): 1.0,
        ("by_doc_type", "invoice"): 1.0, ("avg_processing_time_s", None): 2.0, ("p95_processing_time_s", None): 3.0,
        ("pending_review_items", None): 2.0,
    }


def test_stats_of_nothing(spark):
    got = {r["metric"]: r["value"] for r in j.job_stats(j.job_view(log(spark).limit(0))).collect()}
    assert got == {"total_jobs": 0.0, "avg_processing_time_s": None, "pending_review_items": 0.0}


def test_listing_and_resolution(spark):
    items = j.queue_listing(j.job_view(log(spark)))
    assert items.count() == 3 and j.queue_listing(j.job_view(log(spark)), pending_only=True).count() == 2
    res = spark.createDataFrame(
        [("a", "x", 1, "old", "eve"), ("a", "x", 2, "new", None), ("b", "x", 3, "n", None)],
        "job_id string, field_name string, ord bigint, corrected_value string, resolved_by string",
    )
    rows = j.resolve_items(items, res).collect()
    # Both items of the field are marked, the latest resolution wins, nobody named is a human.
    assert [(r["resolved"], r["corrected_value"], r["resolved_by"]) for r in rows if r["field_name"] == "x"] == [(True, "new", "human")] * 2
    assert [(r["resolved"], r["corrected_value"]) for r in rows if r["field_name"] == "y"] == [(True, None)]
    assert j.resolution_events(res).count() == 3
    assert {r["resolved"]: r["n"] for r in j.pending_split(items).collect()} == {True: 1, False: 2}


def test_resolve_in_queue(spark):
    jobs = j.job_view(log(spark)).filter("job_id = 'a'")
    out = jobs.select(j.resolve_in_queue(F.col("queue"), F.lit("x"), F.lit("fix"), F.lit("ann")).alias("q")).first()["q"]
    assert [(i["field_name"], i["resolved"], i["resolved_by"]) for i in out] == [("x", True, "ann"), ("y", True, None), ("x", True, "ann")]


def test_breakdown(spark):
    got = {r["status"]: r["share"] for r in j.breakdown(j.job_view(log(spark)), "status").collect()}
    assert got == {"done": 1 / 3, "failed": 1 / 3, "pending": 1 / 3}
    empty = spark.createDataFrame([], "status string")
    assert j.breakdown(empty, "status").collect() == []


def test_stream_equals_batch_over_several_triggers(spark):
    source = fresh_path(spark, "log")
    log(spark).repartition(3).write.parquet(source)
    events = stream.event_stream(spark, source, DDL, files_per_trigger=1)
    out = fresh_path(spark, "states")
    stream.publish_states(stream.job_states(events), out, fresh_path(spark, "cp")).awaitTermination()
    columns = ["job_id", "status", "doc_type", "error_message", "processing_time_s"]
    got = stream.current_states(spark, out).select(columns)
    want = j.job_view(log(spark)).select(columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    stats = fresh_path(spark, "stats")
    stream.publish_stats(stream.job_states(events), stats, fresh_path(spark, "cp")).awaitTermination()
    live = {r["status"]: r["n"] for r in stream.last_batch(spark, stats).collect()}
    assert live == {"done": 1, "failed": 1, "pending": 1}


def test_audit_copy_resumes(spark):
    source, out, checkpoint = (fresh_path(spark, n) for n in ("log", "copy", "cp"))
    for part in (log(spark).filter("ord < 5"), log(spark).filter("ord >= 5")):
        part.write.mode("append").parquet(source)
        stream.append_audit(stream.event_stream(spark, source, DDL), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 8
