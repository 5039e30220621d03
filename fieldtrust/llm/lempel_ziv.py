"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed as LZ78 does: a phrase is the shortest stretch not met before. The set of phrases
is hashed, and its ``KEPT`` smallest hashes are the fingerprint. The share of hashes two fingerprints have in
common among the smallest of both estimates the likeness of the phrase sets, which is high when
the one text would help to compress the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import table, whole_text

KEPT = 128
#: Ranges of ids per shuffle partition, and at most.
SPREAD, MOST_RANGES = 4, 2000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factors = np.full((2, size), [[_BASE], [_INVERSE]], "u8")
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1, dtype="u8")
        return self.up, self.down


_powers = _Powers()


def parse(text: str, known: dict[str, None], phrase: str = "") -> str:
    """Adds the phrases of ``text`` to ``known``, going on with ``phrase``; what is left at the end is no phrase."""
    for char in text:
        phrase += char
        if phrase not in known:
            known[phrase] = None
            phrase = ""
    return phrase


def signature(text: str, phrases: dict[str, None], kept: int = KEPT) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases, sorted. The phrases lie one behind the other from the text's start."""
    if not phrases:
        return np.empty(0, "u4")
    lengths = np.fromiter(map(len, phrases), "i8", len(phrases))
    ends = np.cumsum(lengths)
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
    up, down = _powers.to(len(codes))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(codes * up[: len(codes)], dtype="u8")])
    starts = ends - lengths
    hashes = (total[ends] - total[starts]) * down[starts] + lengths.astype("u8")
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    short = (hashes >> np.uint64(32)).astype("u4")
    if len(short) > 4 * kept:
        short = np.partition(short, 2 * kept)[: 2 * kept]
    return np.unique(short)[:kept]


def as_text(signed: np.ndarray) -> str:
    return base64.b64encode(signed.astype(">u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated Jaccard similarity of the phrase sets; 1 for two texts without phrases."""
    both = np.union1d(a, b)[:kept]
    if not len(both):
        return 1.0
    return float(np.isin(both, a).__and__(np.isin(both, b)).sum() / len(both))


def whole_signature(text: str, kept: int = KEPT) -> np.ndarray:
    known: dict[str, None] = {}
    parse(text, known)
    return signature(text, known, kept)


def fingerprint(text: Column, kept: int = KEPT) -> Column:
    """Fingerprint of each text; null counts as empty, whose fingerprint is the empty string."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(whole_signature(t, kept)))

    return run(F.coalesce(text, F.lit("")))


class _Parsed:
    """A document's fingerprint, and its parse up to where its last quarter begins."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 4
        known: dict[str, None] = {}
        self.phrase = parse(text[: self.cut], known)
        self.before = dict(known)
        parse(text[self.cut :], known, self.phrase)
        self.signature = signature(text, known)

    def row(self, following: _Parsed) -> tuple:
        borrowed = following.text[: len(self.text) // 4]
        edited = self.text[: self.cut] + borrowed
        parse(borrowed, self.before, self.phrase)
        changed = signature(edited, self.before)
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(self.signature), as_text(changed), likeness(self.signature, changed), likeness(self.signature, following.signature),
        )


_OUT = (
    ("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of range, own documents before the one that follows the range. Holds one document at a time."""
    held: _Parsed | None = None
    place: int | None = None
    done = False
    for batch in batches:
        out = []
        for number, ahead, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("_range", "_ahead", "doc_id", "text")]):
            if number != place:
                held, place, done = None, number, False
            if done:
                continue  # the document that follows may come in several copies
            now = _Parsed(doc_id, text)
            if held is not None:
                out.append(held.row(now))
            held, done = now, bool(ahead)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind, _) in enumerate(_OUT)], [n for n, _, _ in _OUT])


def with_following(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id long, text): its fingerprint, that of its edited text, and two likenesses.

    The edited text has its last quarter (rounded down) replaced by as many code points, or all, of the next
    document by ascending id; the first follows the last, also a single one itself. Null ids come first;
    rows of one id are in the order of their texts' hashes. Null texts are empty. Extra columns are ignored.

    Documents are cut into ranges of ids, and a task walks through a range in order. What follows a range
    is the first document of the next one: those are found first, a row per range, and sent along.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("_hash", F.xxhash64("text"))
    ranges = min(MOST_RANGES, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    steps = [i / ranges for i in range(1, ranges)]
    # At most MOST_RANGES numbers.
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    number = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(number))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_hash")
    heads = sorted(rows.groupBy("_range").agg(F.min(order).alias("head")).collect(), key=lambda r: r["_range"])
    if not heads:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, _, k in _OUT))
    behind = [(h["head"]["doc_id"], h["head"]["_hash"], heads[i - 1]["_range"]) for i, h in enumerate(heads)]
    # A row per range, at most MOST_RANGES + 1.
    first = F.broadcast(spark.createDataFrame(behind, "_id long, _head long, _before int"))
    sent = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (rows["_hash"] == first["_head"]), "left")
    own = F.struct(F.col("_range"), F.lit(False).alias("_ahead"))
    ahead = F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_ahead"))
    placed = sent.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
    placed = placed.select(F.col("_at._range").alias("_range"), F.col("_at._ahead").alias("_ahead"), "doc_id", "_hash", "text")
    ordered = placed.repartition("_range").sortWithinPartitions("_range", "_ahead", F.col("doc_id").asc_nulls_first(), "_hash")
    return ordered.mapInArrow(_chain, ", ".join(f"{n} {k}" for n, _, k in _OUT))


def op1_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_following(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_phrase_fingerprint": op1_phrase_fingerprint}
