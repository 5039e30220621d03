"""Similar past documents: exact cosine top-k within a document type.

Every query has to be compared with every exemplar of its type, so the comparison itself is
quadratic; what matters is that it is done in bounded blocks. Both sides are cut into blocks of a
fixed number of vectors, each pair of blocks is one matrix product in one task, and only the k best
per query leave it. No pair rows are ever built, and a type that holds most vectors is simply more
blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.functions.fields import has_value, raw_value
from fieldtrust.functions.staging import computed_once
from fieldtrust.schemas import NUMBER_FIELDS
from fieldtrust.session import materialised

# Task code travels with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distances equal to this many decimals are ties, decided by the smaller id.
TIE_DECIMALS = 10
DEFAULT_K = 3
# Blocks of fewer rows are put together for a task: each row is copied once per bundle of the other side, not once per block.
TASK_ROWS = 4096
EMBEDDING_DIM = 768


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|) in double; NULL for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k_similar(
    queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, exclude_same_id: bool = False,
    block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest corpus rows of the query's type.

    ``queries`` has (query_id, doc_type, embedding), ``corpus`` (id, doc_type, embedding) with unique
    ids. Fewer rows of the type give fewer results. Zero vectors match nothing, nor do missing ones,
    ones with missing components and queries of another width than the corpus has. Blocks of less than ``TASK_ROWS``
    rows are put together in bundles of about that many, which travel and are compared as one.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    corpus = corpus.select("id", "doc_type", "embedding").filter(whole)
    queries = queries.select("query_id", "doc_type", "embedding").filter(whole)
    bundled = max(1, TASK_ROWS // block_rows)
    n_blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_rows))
    q_sizes = queries.groupBy("doc_type").agg(n_blocks.alias("q_blocks"))
    c_sizes = corpus.groupBy("doc_type").agg(n_blocks.alias("c_blocks"))
    # A row per document type. Read back from a table its size is known when the joins below are
    # planned: small as it is it is broadcast, and past the threshold it would be shuffled.
    sizes = materialised(q_sizes.join(c_sizes, "doc_type"), "block-counts")

    shared, blocks = ["doc_type", "embedding", "q_block", "c_block"], ["q_block", "c_block"]

    def grid(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        # A row goes to its own block's bundle in every pairing with the other side's bundles.
        block = F.floor(F.pmod(F.xxhash64(id_col), F.col(f"{own}_blocks")) / bundled)
        others = F.floor((F.col(f"{other}_blocks") - 1) / bundled)
        return (
            df.join(sizes, "doc_type")
            .withColumn(f"{own}_block", block)
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("bigint"), others)))
            # New names: both sides may come from one table, as when all documents ask all others.
            .select(*[F.col(c).alias(f"{own}_{c}" if c in shared else c) for c in [*df.columns, *blocks]])
        )

    q_grid = grid(queries, "query_id", "q", "c")
    c_grid = grid(corpus, "id", "c", "q")
    keys = ["doc_type", *blocks]
    q_type = queries.schema["query_id"].dataType.simpleString()
    c_type = corpus.schema["id"].dataType.simpleString()
    pairs = (
        q_grid.groupBy(*[f"q_{c}" for c in keys])
        .cogroup(c_grid.groupBy(*[f"c_{c}" for c in keys]))
        .applyInPandas(
            _block_product(k, exclude_same_id),
            f"query_id {q_type}, id {c_type}, distance double",
        )
    )
    # At most k rows per query and corpus block are left; the final cut keeps k per query.
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        pairs.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


def _unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms > 0, norms, 1.0)[:, None], norms > 0


def _block_product(k: int, exclude_same_id: bool, slab: int = 512) -> Callable:
    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": q["query_id"][:0], "id": c["id"][:0], "distance": []})
        if q.empty or c.empty:
            return empty
        c = c.sort_values("id", kind="stable")
        c_unit, c_ok = _unit_rows(c["c_embedding"])
        c_ids = c["id"].to_numpy()[c_ok]
        c_unit = c_unit[c_ok]
        q_unit, q_ok = _unit_rows(q["q_embedding"])
        q_ids = q["query_id"].to_numpy()[q_ok]
        q_unit = q_unit[q_ok]
        parts = [empty]
        for start in range(0, len(q_ids), slab):
            ids = q_ids[start : start + slab]
            dist = np.round(1.0 - q_unit[start : start + slab] @ c_unit.T, TIE_DECIMALS)
            if exclude_same_id:
                dist[ids[:, None] == c_ids[None, :]] = np.inf
            # Corpus ids ascend, so a stable sort breaks ties by id.
            order = _k_smallest(dist, k)
            picked = np.take_along_axis(dist, order, axis=1)
            keep = np.isfinite(picked).ravel()
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, order.shape[1])[keep],
                        "id": c_ids[order].ravel()[keep],
                        "distance": picked.ravel()[keep],
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return product


def _k_smallest(dist: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k smallest per row, equal values in column order."""
    n = dist.shape[1]
    if n > 8 * k:
        # Cut to everything up to the k-th smallest value first; ties with it all stay in.
        limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        width = int((dist <= limit).sum(axis=1).max())
        if width < n:
            masked = np.where(dist <= limit, np.arange(n), n)
            cols = np.sort(np.partition(masked, width - 1, axis=1)[:, :width], axis=1)
            safe = np.minimum(cols, n - 1)
            values = np.where(cols < n, np.take_along_axis(dist, safe, axis=1), np.inf)
            inner = np.argsort(values, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(safe, inner, axis=1)
    return np.argsort(dist, axis=1, kind="stable")[:, :k]


def exemplar_text(vendor: Column, address: Column, line_items: Column) -> Column:
    """Layout signal of an invoice: vendor, address and item descriptions, one per line.

    Amounts, dates and numbers are left out on purpose; empty parts are dropped.
    """
    items = F.coalesce(line_items, F.array().cast("array<struct<description:string>>"))
    parts = F.concat(F.array(vendor, address), F.transform(items, lambda i: i["description"]))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def document_text(df: DataFrame) -> Column:
    items = F.col("line_items") if "line_items" in df.columns else F.lit(None).cast(
        "array<struct<description:string>>"
    )
    return exemplar_text(
        raw_value(F.col("fields"), "vendor_name"), raw_value(F.col("fields"), "vendor_address"), items
    )


def hashed_embedding(df: DataFrame, text: str = "layout_text", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Default embedder: signed feature hashing of words, unit length, no fitting pass.

    A word's md5 gives its slot (first eight hexadecimal digits modulo ``dim``) and its sign (the ninth one), so words
    that share a slot cancel out on average, and any engine with md5 finds the same vector. A text without words, or
    whose words cancel out, has a zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def feature(digest: Column) -> Column:
        slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
        return F.struct(slot.alias("slot"), F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0).alias("sign"))

    features = F.transform(F.transform(words, lambda w: F.md5(w)), feature)
    vector = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")),
        lambda i: F.aggregate(F.col("_features"), F.lit(0.0), lambda total, f: total + F.when(f["slot"] == i, f["sign"]).otherwise(0.0)),
    )
    staged = computed_once(computed_once(df, "_features", features), "_counts", vector)
    length = F.sqrt(dot(F.col("_counts"), F.col("_counts")))
    staged = staged.withColumn("_length", length)
    unit = F.transform("_counts", lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(x))
    return staged.withColumn("embedding", unit).drop("_features", "_counts", "_length")


def letter_profile(df: DataFrame, text: str = "layout_text") -> DataFrame:
    """Small embedder of built-ins only: how often each Latin letter and digit occurs."""
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    lowered = F.col("_lowered")
    counts = [
        (F.length(lowered) - F.length(F.replace(lowered, F.lit(s), F.lit("")))).cast("double") for s in signs
    ]
    return computed_once(df, "_lowered", F.lower(F.col(text))).withColumn("embedding", F.array(*counts)).drop("_lowered")


def pandas_embedding(
    embed: Callable[[pd.Series], pd.Series], dim: int = EMBEDDING_DIM
) -> Callable[[DataFrame, str], DataFrame]:
    """Embedder from a user's batch function: Series of texts -> Series of float lists."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = embed(texts)
            if any(len(v) != dim for v in out):
                raise ValueError(f"embedding width is not {dim}")
            yield out

    def apply(df: DataFrame, text: str = "layout_text") -> DataFrame:
        return df.withColumn("embedding", vectors(F.col(text)))

    return apply


Embedder = Callable[..., DataFrame]


def ingestable_exemplars(
    results: DataFrame, doc_type: str = "invoice", doc: str = "doc_name"
) -> DataFrame:
    """Exemplar rows (without vectors) of documents where nothing was abstained."""
    clean = results.filter(~F.exists("fields", lambda f: f["status"] == "abstained"))
    return clean.select(
        F.col(doc).alias("id"), F.lit(doc_type).alias("doc_type"),
        document_text(results).alias("layout_text"),
        F.map_from_entries(
            F.transform(
                F.filter("fields", has_value), lambda f: F.struct(f["field"], f["value"])
            )
        ).alias("extracted_fields"),
    ).filter(F.length(F.trim("layout_text")) > 0)


def retrieve_exemplars(
    queries: DataFrame, exemplars: DataFrame, embed: Embedder | None = hashed_embedding,
    k: int = DEFAULT_K, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, id, distance) for queries (query_id, doc_type, layout_text).

    Exemplars come with (id, doc_type, layout_text). Equal texts have equal vectors, so each
    distinct text is embedded and compared once, and of the exemplars sharing a text only the k
    smallest ids can be among the k nearest. That is exact, and keeps one vendor's mass of equal
    layouts from multiplying the work. The few distinct texts are written with their vectors, as
    several joins read them. Without an embedder retrieval is off: no rows.
    """
    if embed is None:
        return queries.sparkSession.createDataFrame(
            [], "query_id string, rank int, id string, distance double"
        )
    queries = queries.filter(F.length(F.trim("layout_text")) > 0).withColumn(
        "text_key", F.md5("layout_text")
    )
    by_text = Window.partitionBy("doc_type", "text_key")
    # The rank filter runs before the shuffle as well, so a text shared by many exemplars sends
    # k rows per input partition and no more.
    heads = materialised(
        exemplars.select("id", "doc_type", "layout_text", F.md5("layout_text").alias("text_key"))
        .withColumn("_nth", F.row_number().over(by_text.orderBy("id")))
        .filter(F.col("_nth") <= k)
        .withColumn("text_id", F.min("id").over(by_text)),
        "exemplar-heads",
    )
    # The k nearest texts, ties by smallest member id, hold the k nearest exemplars.
    corpus_texts = materialised(
        embed(heads.filter(F.col("_nth") == 1).select("id", "doc_type", "layout_text"), "layout_text"),
        "exemplar-vectors",
    )
    query_texts = materialised(
        embed(
            queries.groupBy("doc_type", "text_key").agg(F.min("layout_text").alias("layout_text")),
            "layout_text",
        ).withColumn("query_id", F.concat_ws(":", "doc_type", "text_key")),
        "query-vectors",
    )
    near = top_k_similar(query_texts, corpus_texts, k, block_rows=block_rows)
    members = heads.select("text_id", F.col("id").alias("member"))
    best = Window.partitionBy("query_id").orderBy("distance", "member")
    per_text = (
        near.join(members, near["id"] == members["text_id"])
        .select("query_id", "distance", "member")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumnRenamed("query_id", "_text")
    )
    return (
        queries.withColumn("_text", F.concat_ws(":", "doc_type", "text_key"))
        .join(per_text, "_text")
        .select("query_id", "rank", F.col("member").alias("id"), "distance")
    )


def few_shot_blocks(retrieved: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(query_id, few_shot): retrieved exemplars as one text per query, nearest first.

    At most k exemplars meet in one group. Fields are listed as ``key: 'value'`` without nulls, amounts without quotes.
    """
    found = retrieved.join(exemplars.select("id", "extracted_fields"), "id")
    shots = found.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", F.map_entries("extracted_fields").alias("entries")))
        ).alias("shots")
    )
    return shots.select("query_id", few_shot_text(F.col("shots")).alias("few_shot"))


def few_shot_text(shots: Column) -> Column:
    """Few-shot text of an array of struct(rank, entries array<struct(key, value)>); empty for none."""

    def example(shot: Column, i: Column) -> Column:
        entries = F.filter(shot["entries"], lambda e: e["value"].isNotNull() & (e["key"] != "line_items"))
        vendor = F.get(F.filter(shot["entries"], lambda e: e["key"] == "vendor_name"), F.lit(0))["value"]
        title = F.when(F.coalesce(vendor, F.lit("")) != "", F.concat(F.lit(" ("), vendor, F.lit(")"))).otherwise("")
        header = F.concat(F.lit("--- Example "), (i + 1).cast("string"), title, F.lit(" ---"))
        is_number = lambda e: e["key"].isin(NUMBER_FIELDS) & e["value"].try_cast("double").isNotNull()
        lines = F.transform(
            entries,
            lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.when(is_number(e), e["value"]).otherwise(F.concat(F.lit("'"), e["value"], F.lit("'")))),
        )
        return F.concat(F.array_join(F.concat(F.array(header), lines), "\n"), F.lit("\n"))

    intro = "Earlier documents that look alike, with the values read from them:\n"
    outro = "Formats and layout are likely to be the same in this one.\n"
    body = F.array_join(F.transform(shots, example), "\n")
    return F.when(F.size(shots) == 0, F.lit("")).otherwise(
        F.concat(F.lit(intro + "\n"), body, F.lit("\n" + outro))
    )
