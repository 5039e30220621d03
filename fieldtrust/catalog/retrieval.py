"""Similar documents: vectors of the embeddings table and layout texts of invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.carriers import table
from fieldtrust.catalog.sql import PRED_LONG, RECORDS
from fieldtrust.operators import pruned
from fieldtrust.operators import retrieval as r
from fieldtrust.operators.gate import apply_gate


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc_type"), "embedding"
    )


def cosine_distances(spark, sf):
    """Distance of each vector to its successor."""
    v = _vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(other, "id").select(
        "id", F.round(r.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance")
    )


def top_k_vectors(spark, sf):
    """Three nearest other vectors of the same label, for every vector."""
    v = _vectors(spark, sf)
    near = r.top_k_similar(v.withColumnRenamed("id", "query_id"), v, 3, exclude_same_id=True)
    return near.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def top_k_vectors_small_blocks(spark, sf):
    """The same cut into many small blocks."""
    v = _vectors(spark, sf)
    near = r.top_k_similar(v.withColumnRenamed("id", "query_id"), v, 3, exclude_same_id=True, block_rows=16)
    return near.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def top_k_pruned(spark, sf):
    """The same, each vector meeting only cells of vectors that may hold one of its nearest."""
    v = _vectors(spark, sf)
    near, _ = pruned.top_k_pruned(v.withColumnRenamed("id", "query_id"), pruned.PrunedIndex(v, cell_rows=16), 3, exclude_same_id=True, block_rows=64)
    return near.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def _layouts(spark, sf):
    records = carriers.invoice_records(spark, sf)
    items = F.array(
        F.struct(F.col("currency").alias("description")), F.struct(F.lit("").alias("description")),
        F.struct(F.lit(None).cast("string").alias("description")),
    )
    return records.select(
        "k", F.col("doc_name").alias("id"), F.lit("invoice").alias("doc_type"),
        r.exemplar_text(F.col("vendor_name"), F.col("vendor_address"), items).alias("layout_text"),
        "vendor_name", "currency", "due_date",
    )


def exemplar_texts(spark, sf):
    return _layouts(spark, sf).select("id", "layout_text")


def _queries_and_exemplars(spark, sf):
    """Every invoice asks; its first vendor's layouts are the past documents."""
    layouts = _layouts(spark, sf)
    queries = layouts.select(F.col("id").alias("query_id"), "doc_type", F.upper("layout_text").alias("layout_text"))
    fields = F.map_from_arrays(
        F.array(F.lit("vendor_name"), F.lit("currency"), F.lit("due_date")), F.array("vendor_name", "currency", "due_date")
    )
    return queries, layouts.select("id", "doc_type", "layout_text", fields.alias("extracted_fields"))


def similar_documents(spark, sf):
    queries, exemplars = _queries_and_exemplars(spark, sf)
    found = r.retrieve_exemplars(queries, exemplars, r.letter_profile)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def similar_documents_hashed(spark, sf):
    """With the default hashed embedding."""
    queries, exemplars = _queries_and_exemplars(spark, sf)
    found = r.retrieve_exemplars(queries, exemplars)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def few_shot_blocks(spark, sf):
    queries, exemplars = _queries_and_exemplars(spark, sf)
    found = r.retrieve_exemplars(queries, exemplars, r.letter_profile)
    return r.few_shot_blocks(found, exemplars)


def retrieval_off(spark, sf):
    """Without an embedder nothing is retrieved and the caller goes on."""
    queries, exemplars = _queries_and_exemplars(spark, sf)
    found = r.retrieve_exemplars(queries, exemplars, None)
    return queries.join(found, "query_id", "left").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def ingestable_exemplars(spark, sf):
    """Documents that may become exemplars: nothing abstained."""
    gated = carriers.invoice_predictions(spark, sf).withColumn("fields", apply_gate(F.col("fields"), 0.55))
    return r.ingestable_exemplars(gated).select(
        "id", "layout_text", F.try_element_at("extracted_fields", F.lit("subtotal")).alias("subtotal"),
        F.size("extracted_fields").cast("bigint").alias("n_fields"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        cosine_distances, top_k_vectors, top_k_vectors_small_blocks, top_k_pruned, exemplar_texts, similar_documents,
        similar_documents_hashed, few_shot_blocks, retrieval_off, ingestable_exemplars,
    )
}

_COS = "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_TOPK = f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 10) AS d FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p)
    SELECT query_id, rank, id, round(d, 6) AS distance FROM r WHERE rank <= 3"""
_TEXT = "vendor_name || chr(10) || vendor_address || chr(10) || currency"
_SIGNS = ", ".join(f"(length(x) - length(replace(x, '{s}', '')))::DOUBLE" for s in "abcdefghijklmnopqrstuvwxyz0123456789")
# Per text, compared once; the three smallest ids of a text are all that can be among the nearest.
_SIMILAR = f"""WITH {RECORDS}, lay AS (SELECT doc_name AS id, lower({_TEXT}) AS x, vendor_name, currency, due_date FROM records),
    texts AS (SELECT x, [{_SIGNS}] AS e FROM (SELECT DISTINCT x FROM lay)),
    members AS (SELECT x, id FROM (SELECT x, id, row_number() OVER (PARTITION BY x ORDER BY id) AS rn FROM lay) WHERE rn <= 3),
    cand AS (SELECT q.x AS qx, m.id, round(1 - list_cosine_similarity(q.e, c.e), 10) AS d FROM texts q, texts c JOIN members m ON m.x = c.x),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qx ORDER BY d, id) AS rank FROM cand) WHERE rank <= 3),
    found AS (SELECT lay.id AS query_id, rank, best.id, d FROM lay JOIN best ON lay.x = best.qx)"""
_SHOT = """'--- Example ' || rank || ' (' || e.vendor_name || ') ---' || chr(10) || '  vendor_name: ''' || e.vendor_name || '''' || chr(10)
    || '  currency: ''' || e.currency || '''' || CASE WHEN e.due_date IS NULL THEN '' ELSE chr(10) || '  due_date: ''' || e.due_date || '''' END || chr(10)"""

ORACLES = {
    "cosine_distances": f"SELECT a.vec_id AS id, round({_COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "top_k_vectors": _TOPK,
    "top_k_vectors_small_blocks": _TOPK,
    "top_k_pruned": _TOPK,
    "exemplar_texts": f"WITH {RECORDS} SELECT doc_name AS id, {_TEXT} AS layout_text FROM records",
    "similar_documents": f"{_SIMILAR} SELECT query_id, rank, id, round(d, 6) AS distance FROM found",
    "similar_documents_hashed": f"""WITH {RECORDS}, lay AS (SELECT doc_name AS id, lower({_TEXT}) AS x FROM records), texts AS (SELECT DISTINCT x FROM lay),
        slots AS (SELECT x, ('0x' || substr(md5(w), 1, 8))::BIGINT % 768 AS slot, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v
            FROM (SELECT x, unnest(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM texts) GROUP BY ALL),
        norms AS (SELECT x, sqrt(sum(v * v)) AS n FROM slots GROUP BY x HAVING n > 0),
        dots AS (SELECT a.x AS qx, b.x AS cx, sum(a.v * b.v) AS d FROM slots a JOIN slots b USING (slot) GROUP BY ALL),
        members AS (SELECT x, id FROM (SELECT x, id, row_number() OVER (PARTITION BY x ORDER BY id) AS rn FROM lay) WHERE rn <= 3),
        cand AS (SELECT q.x AS qx, m.id, round(1 - coalesce(dots.d, 0) / (q.n * c.n), 10) AS d FROM norms q CROSS JOIN norms c JOIN members m ON m.x = c.x
            LEFT JOIN dots ON dots.qx = q.x AND dots.cx = c.x),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qx ORDER BY d, id) AS rank FROM cand) WHERE rank <= 3)
        SELECT lay.id AS query_id, rank, best.id, round(d, 6) AS distance FROM lay JOIN best ON lay.x = best.qx""",
    "few_shot_blocks": f"""{_SIMILAR} SELECT query_id, 'Earlier documents that look alike, with the values read from them:' || chr(10) || chr(10)
        || string_agg({_SHOT}, chr(10) ORDER BY rank) || chr(10) || 'Formats and layout are likely to be the same in this one.'
        || chr(10) AS few_shot FROM found JOIN lay e ON e.id = found.id GROUP BY query_id""",
    "retrieval_off": f"WITH {RECORDS} SELECT NULL::INTEGER AS rank, count(*) AS n FROM records",
    "ingestable_exemplars": f"""WITH {RECORDS}, {PRED_LONG} SELECT doc_name AS id, max(value) FILTER (WHERE field = 'vendor_name') || chr(10)
        || max(value) FILTER (WHERE field = 'vendor_address') AS layout_text, max(value) FILTER (WHERE field = 'subtotal') AS subtotal, count(value) AS n_fields
        FROM pred GROUP BY doc_name HAVING count(*) FILTER (WHERE value IS NOT NULL AND confidence < 0.55::DOUBLE) = 0""",
}
