"""Job view, statistics, queue and streaming over the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.operators import jobs as j
from fieldtrust.operators.job_table import JobTable
from fieldtrust.operators.ranking import value_at_fraction
from fieldtrust.session import fresh_path
from fieldtrust.sources.writers import append_events
from fieldtrust.streaming import jobs as stream


def _jobs(spark, sf):
    return j.job_view(carriers.job_log(spark, sf))


def _shown(df):
    return df.select(
        "job_id", "status", "doc_name", "doc_type", "error_message", "processing_time_s"
    )


def job_view(spark, sf):
    return _shown(_jobs(spark, sf))


def job_lifecycle(spark, sf):
    """Jobs by their path through the states."""
    log = carriers.job_log(spark, sf)
    return log.groupBy("event_type", j.status_of_event(F.col("event_type")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("n_jobs")
    )


def job_lookup(spark, sf):
    return _shown(j.job_by_id(_jobs(spark, sf), "7"))


def job_stats(spark, sf):
    return j.job_stats(_jobs(spark, sf))


def processing_time_p95(spark, sf):
    """Nearest-rank 95 % value of all event values, per event type."""
    return value_at_fraction(carriers.table(spark, sf, "events"), "value", 0.95, ["event_type"])


def order_value_p95(spark, sf):
    return value_at_fraction(carriers.table(spark, sf, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"])


def account_balance_median(spark, sf):
    """The same rank over values of both signs."""
    return value_at_fraction(carriers.table(spark, sf, "customer"), "c_acctbal", 0.5, alias="median")


def queue_listing(spark, sf):
    return j.queue_listing(_jobs(spark, sf)).select(
        "job_id", "doc_name", "field_name", "extracted_value", "confidence", "reason", "resolved"
    )


def queue_pending(spark, sf):
    return j.queue_listing(_jobs(spark, sf), pending_only=True).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n")
    )


def queue_split(spark, sf):
    return j.pending_split(j.queue_listing(_jobs(spark, sf)))


def _resolutions(spark, sf):
    log = carriers.job_log(spark, sf).filter(F.col("event_type") == "field_resolved")
    names = F.array(*[F.lit(n) for n in ("invoice_number", "invoice_date", "due_date")])
    return log.select(
        "job_id", F.get(names, (F.col("ord") % 3).cast("int")).alias("field_name"), "ord",
        F.concat(F.lit("fixed "), F.col("ord")).alias("corrected_value"),
        F.when(F.col("ord") % 2 == 0, F.col("doc_name")).alias("resolved_by"),
    )


def queue_resolved(spark, sf):
    items = j.queue_listing(_jobs(spark, sf))
    return j.resolve_items(items, _resolutions(spark, sf)).select(
        "job_id", "field_name", "resolved", "corrected_value", "resolved_by"
    )


def queue_resolved_in_place(spark, sf):
    """One resolution per job applied to its nested queue."""
    jobs = _jobs(spark, sf).filter((F.col("status") == "done") & F.col("queue").isNotNull())
    queue = j.resolve_in_queue(
        F.col("queue"), F.lit("invoice_date"), F.concat(F.lit("by "), F.col("doc_name")), F.lit(None).cast("string")
    )
    return j.queue_listing(jobs.withColumn("queue", queue)).select(
        "job_id", "field_name", "resolved", "corrected_value", "resolved_by"
    )


def resolution_events(spark, sf):
    return j.resolution_events(_resolutions(spark, sf)).groupBy("event_type", "payload").agg(
        F.count(F.lit(1)).alias("n")
    )


def status_breakdown(spark, sf):
    return j.breakdown(_jobs(spark, sf), "status").withColumn("share", F.round("share", 6))


def doc_type_breakdown(spark, sf):
    return j.breakdown(_jobs(spark, sf), "doc_type").withColumn("share", F.round("share", 6))


def latest_values(spark, sf):
    """Latest non-null value per key over the raw events of a user."""
    e = carriers.table(spark, sf, "events").withColumn(
        "purchase", F.when(F.col("event_type") == "purchase", F.col("value"))
    )
    return e.groupBy("user_id").agg(j.latest("purchase", "event_id").alias("last_purchase"))


def _log_files(spark, sf) -> str:
    path = fresh_path(spark, "audit")
    append_events(carriers.job_log(spark, sf), path)
    return path


def _log_stream(spark, sf, triggers=None):
    source = _log_files(spark, sf)
    log = spark.read.parquet(source)
    return stream.event_stream(spark, source, log.schema, triggers and -(-len(log.inputFiles()) // triggers))


def streaming_job_states(spark, sf):
    states = stream.job_states(_log_stream(spark, sf))
    out = fresh_path(spark, "states")
    stream.publish_states(states, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return _shown(stream.current_states(spark, out))


def streaming_job_stats(spark, sf):
    states = stream.job_states(_log_stream(spark, sf))
    out = fresh_path(spark, "stats")
    stream.publish_stats(states, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return stream.last_batch(spark, out)


def job_table_merge(spark, sf):
    """Job states merged into a stored table in quarters of the log, the last one twice and the first one once more, late."""
    log = carriers.job_log(spark, sf)
    quarter = F.floor(F.col("ord") / F.lit(2000)) % 4
    stored = JobTable(spark, fresh_path(spark, "jobs"), buckets=16)
    for i in (0, 1, 2, 3, 3, 0):
        part = log.filter(quarter == i).groupBy("job_id").agg(F.max("ord").alias("updated_ord"), F.max_by("event_type", "ord").alias("last_event"), F.max_by("doc_name", "ord").alias("doc_name"))
        stored.upsert(part)
    stored.vacuum(1)
    return stored.read()


def compacted_states(spark, sf):
    """The stream's states in a stored table, after several triggers."""
    stored = JobTable(spark, fresh_path(spark, "jobs"), buckets=16)
    stream.merge_states(stream.job_states(_log_stream(spark, sf, triggers=3)), stored, fresh_path(spark, "checkpoint")).awaitTermination()
    return _shown(stored.read())


def streaming_audit_copy(spark, sf):
    out = fresh_path(spark, "copy")
    stream.append_audit(_log_stream(spark, sf), out, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("n_jobs")
    )


QUERIES = {
    f.__name__: f
    for f in (
        job_view, job_lifecycle, job_lookup, job_stats, processing_time_p95, order_value_p95,
        account_balance_median, queue_listing, queue_pending, queue_split, queue_resolved,
        queue_resolved_in_place, resolution_events, status_breakdown, doc_type_breakdown,
        latest_values, job_table_merge, compacted_states, streaming_job_states, streaming_job_stats, streaming_audit_copy,
    )
}

_LOG = """log AS (
  SELECT (event_id // 8)::VARCHAR AS job_id, event_id AS ord, ts, user_id, (props->>'$.k')::INTEGER AS k, value,
    CASE event_type WHEN 'signup' THEN 'doc_received' WHEN 'view' THEN 'extraction_started' WHEN 'click' THEN 'extraction_done'
      WHEN 'error' THEN 'extraction_failed' WHEN 'purchase' THEN 'field_resolved' END AS event_type,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' END AS st
  FROM events)"""
_JOBS = f"""WITH {_LOG}, jobs AS (
  SELECT job_id, arg_max(st, ord) FILTER (WHERE st IS NOT NULL) AS status,
    arg_max('doc_' || user_id, ord) FILTER (WHERE event_type = 'doc_received') AS doc_name,
    arg_max(CASE user_id % 3 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'invoice' ELSE '' END, ord) FILTER (WHERE event_type = 'extraction_done') AS doc_type,
    arg_max('error ' || k, ord) FILTER (WHERE event_type = 'extraction_failed') AS error_message,
    arg_max(value, ord) FILTER (WHERE event_type IN ('extraction_done', 'extraction_failed')) AS processing_time_s,
    arg_max(k, ord) FILTER (WHERE event_type = 'extraction_done') AS qk,
    arg_max(user_id, ord) FILTER (WHERE event_type = 'extraction_done') AS quser
  FROM log GROUP BY job_id HAVING count(*) FILTER (WHERE event_type = 'doc_received') > 0)"""
_ITEMS = f"""{_JOBS}, names AS (SELECT unnest([0, 1, 2]) AS i, unnest(['invoice_number', 'invoice_date', 'due_date']) AS field_name),
all_items AS (SELECT jobs.*, field_name, i, (qk + i) % 5 = 0 AS resolved FROM jobs JOIN names ON i < qk % 4),
items AS (SELECT job_id, doc_name, field_name, quser::VARCHAR AS extracted_value, qk::DOUBLE / 100.0::DOUBLE AS confidence,
  CASE WHEN qk < 50 THEN 'abstained' ELSE 'no_source_location' END AS reason, resolved FROM all_items WHERE status = 'done')"""
_SHOWN = "job_id, status, doc_name, doc_type, error_message, processing_time_s"
_RANK = """SELECT {g}{v} AS {a} FROM (SELECT *, row_number() OVER ({p}ORDER BY {v}) AS rn, count(*) OVER ({p2}) AS n FROM {t})
  WHERE rn = floor(n * {f}::DOUBLE)::BIGINT + 1"""
_RES = """res AS (SELECT job_id, ['invoice_number', 'invoice_date', 'due_date'][(ord % 3 + 1)::INTEGER] AS field_name, ord,
  'fixed ' || ord AS corrected_value, CASE WHEN ord % 2 = 0 THEN 'doc_' || user_id END AS resolved_by FROM log WHERE event_type = 'field_resolved')"""

ORACLES = {
    "job_view": f"{_JOBS} SELECT {_SHOWN} FROM jobs",
    "job_lifecycle": f"WITH {_LOG} SELECT event_type, st AS status, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM log GROUP BY ALL",
    "job_lookup": f"{_JOBS} SELECT {_SHOWN} FROM jobs WHERE job_id = '7'",
    "job_stats": f"""{_ITEMS} SELECT 'total_jobs' AS metric, NULL::VARCHAR AS key, count(*)::DOUBLE AS value FROM jobs
        UNION ALL SELECT 'by_status', status, count(*)::DOUBLE FROM jobs GROUP BY status
        UNION ALL SELECT 'by_doc_type', doc_type, count(*)::DOUBLE FROM jobs WHERE doc_type <> '' GROUP BY doc_type
        UNION ALL SELECT 'avg_processing_time_s', NULL, round(avg(processing_time_s), 2) FROM jobs
        UNION ALL SELECT 'p95_processing_time_s', NULL, round(processing_time_s, 2) FROM (SELECT processing_time_s, row_number() OVER (ORDER BY processing_time_s) AS rn,
          count(*) OVER () AS n FROM jobs WHERE processing_time_s IS NOT NULL) WHERE rn = floor(n * 0.95::DOUBLE)::BIGINT + 1
        UNION ALL SELECT 'pending_review_items', NULL, count(*) FILTER (WHERE NOT resolved)::DOUBLE FROM all_items""",
    "processing_time_p95": _RANK.format(g="event_type, ", v="value", a="p95", p="PARTITION BY event_type ", p2="PARTITION BY event_type", t="events", f="0.95"),
    "order_value_p95": _RANK.format(g="l_returnflag, ", v="l_extendedprice", a="p95", p="PARTITION BY l_returnflag ", p2="PARTITION BY l_returnflag", t="lineitem", f="0.95"),
    "account_balance_median": _RANK.format(g="", v="c_acctbal", a="median", p="", p2="", t="customer", f="0.5"),
    "queue_listing": f"{_ITEMS} SELECT * FROM items",
    "queue_pending": f"{_ITEMS} SELECT field_name, count(*) AS n FROM items WHERE NOT resolved GROUP BY field_name",
    "queue_split": f"{_ITEMS} SELECT resolved, count(*) AS n FROM items GROUP BY resolved",
    "queue_resolved": f"""{_ITEMS}, {_RES}, last AS (SELECT job_id, field_name, arg_max({{'c': corrected_value, 'r': resolved_by}}, ord) AS v FROM res GROUP BY ALL)
        SELECT items.job_id, items.field_name, items.resolved OR v IS NOT NULL AS resolved, v.c AS corrected_value,
        CASE WHEN v IS NOT NULL THEN coalesce(v.r, 'human') END AS resolved_by FROM items LEFT JOIN last USING (job_id, field_name)""",
    "queue_resolved_in_place": f"""{_ITEMS} SELECT job_id, field_name, resolved OR field_name = 'invoice_date' AS resolved,
        CASE WHEN field_name = 'invoice_date' THEN 'by ' || doc_name END AS corrected_value,
        CASE WHEN field_name = 'invoice_date' THEN 'human' END AS resolved_by FROM items""",
    "resolution_events": f"""WITH {_LOG}, {_RES} SELECT 'field_resolved' AS event_type, '{{"field_name":"' || field_name || '"'
        || CASE WHEN resolved_by IS NULL THEN '' ELSE ',"resolved_by":"' || resolved_by || '"' END || '}}' AS payload, count(*) AS n FROM res GROUP BY ALL""",
    "status_breakdown": f"{_JOBS} SELECT status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM jobs WHERE status IS NOT NULL GROUP BY status",
    "doc_type_breakdown": f"{_JOBS} SELECT doc_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM jobs WHERE doc_type <> '' GROUP BY doc_type",
    "latest_values": "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id",
    "streaming_job_states": f"{_JOBS} SELECT {_SHOWN} FROM jobs",
    "compacted_states": f"{_JOBS} SELECT {_SHOWN} FROM jobs",
    "job_table_merge": f"WITH {_LOG} SELECT job_id, max(ord) AS updated_ord, arg_max(event_type, ord) AS last_event, arg_max('doc_' || user_id, ord) AS doc_name FROM log GROUP BY job_id",
    "streaming_job_stats": f"{_JOBS} SELECT status, count(*) AS n, round(avg(processing_time_s), 2) AS avg_processing_time_s FROM jobs GROUP BY status",
    "streaming_audit_copy": f"WITH {_LOG} SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM log GROUP BY ALL",
}
