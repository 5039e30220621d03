"""Label files, import batches and document listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.media import file_kind, kind_of_suffix, pdf_is_whole, pdf_pages
from fieldtrust.functions.staging import computed_once
from fieldtrust.schemas import INVOICE_LABEL_DDL, RAW_INVOICE_DDL, RAW_STATEMENT_DDL

# Document formats taken in.
PDF_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"]
UPLOAD_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg"]
# What a codec adds to the name of a file it packs.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.substring_index(path, "/", -1), r"\+", "%2B"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def scan_labels(
    spark: SparkSession, path: str, schema: str = INVOICE_LABEL_DDL, multi_line: bool = True,
    glob: str = "*.json",
) -> tuple[DataFrame, DataFrame]:
    """(labels, skipped): label files with ``doc_name``, and the files that are no valid JSON.

    ``multi_line`` reads one pretty-printed label per file; without it files hold one label per
    line and can be split, which is the layout for large corpora. Packed files are read whole by a task each.
    """
    text = (
        spark.read.option("pathGlobFilter", glob).text(path, wholetext=multi_line)
        .select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("label_path"))
    )
    parsed = _with_raw(text, "record", schema)
    doc_name = F.coalesce(
        F.nullif(F.col("_meta.doc_file"), F.lit("")),
        F.concat(file_stem(F.regexp_replace("label_path", _PACKED, "")), F.lit(".pdf")),
    )
    labels = (
        parsed.filter(F.col("raw").isNotNull()).select("label_path", "raw.*")
        .drop("_corrupt_record").withColumn("doc_name", doc_name)
    )
    skipped = parsed.filter(F.col("raw").isNull()).select(
        "label_path", "record", F.lit("invalid JSON").alias("reason")
    )
    return labels, skipped


def with_documents(labels: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, missing): labels whose document exists, and a warning row for each other."""
    docs = listing.select("doc_name")
    missing = labels.join(docs, "doc_name", "left_anti").select(
        "doc_name", F.lit("document not found").alias("reason")
    )
    return labels.join(docs, "doc_name", "left_semi"), missing


def read_invoice_batch(spark: SparkSession, path: str) -> DataFrame:
    """(filename, json_data, ocred_text, raw) of a batch CSV with embedded JSON."""
    rows = (
        spark.read.schema("filename string, json_data string, ocred_text string")
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return with_raw_invoice(rows)


def _with_raw(rows: DataFrame, json_column: str, ddl: str) -> DataFrame:
    parsed = F.from_json(
        json_column, f"{ddl}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}
    )
    staged = computed_once(rows, "_parsed", parsed)
    return staged.withColumn(
        "raw", F.when(F.col("_parsed._corrupt_record").isNull(), F.col("_parsed"))
    ).drop("_parsed")


def with_raw_invoice(rows: DataFrame, json_column: str = "json_data") -> DataFrame:
    """Parse the embedded JSON; bad JSON gives ``raw`` NULL instead of a row of nulls."""
    return _with_raw(rows, json_column, RAW_INVOICE_DDL)


def with_raw_statement(rows: DataFrame, json_column: str = "json_data") -> DataFrame:
    return _with_raw(rows, json_column, RAW_STATEMENT_DDL)


def read_statement_batch(spark: SparkSession, root: str) -> DataFrame:
    """(doc_file, subtype, raw) of ``root/<subtype>/<name>.json``."""
    files = (
        spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    subtype = file_name(F.element_at(F.split("path", "/"), -2))
    named = files.select(
        F.col("value").alias("json_data"), subtype.alias("subtype"),
        F.concat(
            F.lit("bankstmt_"), F.lower(subtype), F.lit("_"), file_stem(F.col("path")), F.lit(".pdf")
        ).alias("doc_file"),
    )
    return with_raw_statement(named).drop("json_data")


def document_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of a folder's files; contents are not read.

    Spark leaves files of zero bytes out of a scan, so those count as missing documents.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length")
    )


def intake(
    listing: DataFrame, suffixes: list[str] | None = None, size: str | None = "length",
    path: str = "path",
) -> DataFrame:
    """Listing with ``doc_name``, ``suffix``, ``ok`` and ``error``; a bad file is a row, not a failure."""
    allowed = PDF_SUFFIXES + IMAGE_SUFFIXES if suffixes is None else suffixes
    suffix = file_suffix(F.col(path))
    error = F.when(
        ~suffix.isin(allowed), F.concat(F.lit("cannot read files of type '"), suffix, F.lit("'"))
    )
    if size is not None:
        error = error.when(F.coalesce(F.col(size), F.lit(0)) == 0, F.lit("document has no pages"))
    return (
        listing.withColumn("doc_name", file_name(F.col(path)))
        .withColumn("suffix", suffix)
        .withColumn("error", error)
        .withColumn("ok", F.col("error").isNull())
    )


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows that ``write_ordered`` has written, each with its 0-based ``position``; nothing is sorted again."""
    rows = spark.read.parquet(f"{path}/rows")
    files = spark.read.parquet(f"{path}/files").select(F.col("file").alias("_file"), "first")
    placed = rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_index"))
    return placed.join(files, F.col("_name") == F.col("_file")).select(*rows.columns, (F.col("first") + F.col("_index")).alias("position"))


def document_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def inspected(files: DataFrame, suffixes: list[str] | None = None, path: str = "path") -> DataFrame:
    """Files (path, content) with ``doc_name``, ``suffix``, ``kind``, ``n_pages``, ``ok`` and ``error``; contents are not carried on.

    A file is bad if its suffix is not taken in, its content is of another kind than the suffix says, a PDF breaks off
    before its end, or there is no page. Only signatures and page objects are looked at; nothing is decoded.
    """
    allowed = PDF_SUFFIXES + IMAGE_SUFFIXES if suffixes is None else suffixes
    content = F.coalesce("content", F.lit(b""))
    named = files.select(
        *[c for c in files.columns if c != "content"], file_name(F.col(path)).alias("doc_name"), file_suffix(F.col(path)).alias("suffix"),
        file_kind(content).alias("kind"), F.when(file_kind(content) == "pdf", pdf_pages(content)).otherwise(F.when(file_kind(content).isNotNull(), 1).otherwise(0)).alias("n_pages"),
        (file_kind(content) != "pdf").alias("_image"), pdf_is_whole(content).alias("_whole"), (F.octet_length(content) == 0).alias("_empty"),
    )
    error = (
        F.when(~F.col("suffix").isin(allowed), F.concat(F.lit("cannot read files of type '"), "suffix", F.lit("'")))
        .when(F.col("_empty"), F.lit("document has no pages"))
        .when(~F.col("kind").eqNullSafe(kind_of_suffix(F.col("suffix"))), F.concat(F.lit("content is not what '"), "suffix", F.lit("' says")))
        .when(~F.col("_image") & ~F.col("_whole"), F.lit("document breaks off"))
        .when(F.col("n_pages") == 0, F.lit("document has no pages"))
    )
    return named.withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("_image", "_whole", "_empty")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet table, or an empty one with the schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
