"""N-gram Jaccard join by MinHash banding, every candidate verified on its full n-gram set.

Texts with equal n-gram sets form one node; copies are never paired. Bands and rows are chosen for a
target recall. Nodes that share a band hash are candidates; instead of listing the pairs of a bucket,
each member is tied to the bucket's smallest node, and the connected groups of those ties are verified
as a whole: cut into blocks, a task compares two blocks with each other on full sets and puts out,
per node, how many nodes and documents it links to and one tie to the group it belongs to. So rows
stay linear in the nodes however large a group of near copies is, and no link inside it is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, slices, table, whole_text

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.995
MAX_HASHES = 128
#: Nodes in a block; a task holds two blocks at a time.
BLOCK = 256
#: N-grams of two blocks that are compared at once.
SLAB = 4096
_WORD_TABLE = 200_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with most rows such that a pair at the threshold shares a band with probability ``recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """N-gram sets as sorted 64-bit hashes. Words are what white space separates; a shorter text is one n-gram."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self._known: dict[str, int] = {}
        self._factors = np.random.default_rng(7).integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def grams(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, "u8")
        known = self._known
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > _WORD_TABLE:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            hashes = [known[w] for w in words]
        each = np.array(hashes, "u8")
        n = min(self.words, len(each))
        last = len(each) - n + 1
        total = np.full(last, np.uint64(n))
        for i in range(n):
            total = _mixed(total + each[i : i + last] * self._factors[i])
        return np.unique(total)


@lru_cache(maxsize=2)
def worker_shingler(words: int) -> Shingler:
    return Shingler(words)


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of each multiplicative hash over the set."""
    out = np.full(len(factors), np.uint64(2**64 - 1))
    for at in range(0, len(grams), 512):
        np.minimum(out, (grams[at : at + 512, None] * factors[None, :]).min(axis=0), out=out)
    return out


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.arange(1, bands + 1, dtype="u8")
    for column in least.reshape(bands, rows).T:
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view("i8")


def _sketch(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_shingler(words)
        factors = np.random.default_rng(11).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches):
            sets = [shingler.grams(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            hashed = [band_hashes(signature(s, factors), bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), pa.array(keys, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))],
                ["doc_id", "_row", "_key", "_bands"],
            )

    return run


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, which equal rows (doc_id and text) share and no others."""
    return docs.withColumn("_row", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), whole_text())))


def components(ties: DataFrame) -> DataFrame:
    """(node, root) of every node in ``ties`` (a, b) but the roots: the smallest node of its connected group.

    Alternates large-star and small-star rounds until nothing changes; each round is written to the
    shared folder, and only its row count and checksum come to the driver.
    """
    def oriented(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def starred(pairs: DataFrame) -> DataFrame:
        """Every pair (x, y) becomes (y, smallest neighbour of x or x itself)."""
        least = pairs.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        return pairs.join(least, "a")

    edges, seen = materialised(oriented(ties), "ties"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = starred(both).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = oriented(large)
        small = starred(large).select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("p"))
        edges = materialised(oriented(small.select("p.*")), "stars")


def compare(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets at ``first`` and at ``second`` have at least that Jaccard similarity, as a matrix."""
    grams, places = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(places) > 1
    number = np.cumsum(shared) - 1
    keep = shared[places]
    column, owner = number[places[keep]], owners[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(first), len(second)), "f4")
    for start in range(0, int(shared.sum()), SLAB):
        low, high = np.searchsorted(column, [start, start + SLAB])
        slab = np.zeros((len(sets), SLAB), "f4")
        slab[owner[low:high], column[low:high] - start] = 1
        common += slab[first] @ slab[second].T
    size = np.array([len(s) for s in sets], "i8")
    exact = Fraction(str(threshold))
    both = common.astype("i8")
    union = size[first][:, None] + size[second][None, :] - both
    return both * exact.denominator >= union * exact.numerator


def _verify(words: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells arrive in order; a cell's rows are two blocks of one group, or one block with itself."""

    def cell(rows: list[tuple], shingler: Shingler) -> list[tuple]:
        rows = list({r[3]: r for r in rows}.values())  # repeated rows bring a node's text again
        low, high = rows[0][1], rows[0][2]
        sets = [shingler.grams(r[6]) for r in rows]
        block, copies = np.array([r[4] for r in rows]), np.array([r[5] for r in rows], "i8")
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(first) or not len(second):
            return []
        links = compare(sets, first, second, threshold)
        if low == high:
            np.fill_diagonal(links, False)
        nodes, documents, root = np.zeros(len(rows), "i8"), np.zeros(len(rows), "i8"), np.arange(len(rows))
        nodes[first] += links.sum(1)
        documents[first] += links @ copies[second]
        if low != high:
            nodes[second] += links.sum(0)
            documents[second] += links.T @ copies[first]
        while True:  # the smallest place each row is connected to
            before = root.copy()
            reach = np.where(links, root[second][None, :], len(rows)).min(1)
            root[first] = np.minimum(root[first], reach)
            reach = np.where(links, root[first][:, None], len(rows)).min(0)
            root[second] = np.minimum(root[second], reach)
            if (root == before).all():
                break
        return [(rows[i][3], rows[root[i]][3], int(nodes[i]), int(documents[i])) for i in range(len(rows)) if nodes[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_shingler(words)
        held: list[tuple] = []
        for batch in slices(batches):
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if held and held[0][:3] != row[:3]:
                    out += cell(held, shingler)
                    held = []
                held.append(row)
            yield linked(out)
        if held:
            yield linked(cell(held, shingler))

    def linked(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_key", "_tie", "n_classes", "n_docs"])

    return run


def join(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, class_id, copy_of, n_links, n_text_links and row keys.

    n_links counts the other documents with at least that similarity, copies included; n_text_links the
    other n-gram sets; copy_of is the smallest doc_id with the same set and class_id the smallest of
    all that links connect. A text without words (or null) links to nothing and is its own class. Rows with
    a null id take part and come last in the choice of a smallest. Repeated rows give repeated rows.
    Extra columns are ignored. Intermediate tables are written to the shared folder.
    """
    bands, rows = bands_and_rows(threshold, recall)
    texts = with_row_key(docs.select("doc_id", whole_text().alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _row string, _key binary, _bands array<long>"
    light = materialised(texts.mapInArrow(_sketch(words, bands, rows), schema), "sketches")

    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col("_row").alias("row")))
    nodes = light.where("_key is not null").groupBy("_key").agg(
        F.count("*").alias("_copies"), smallest.alias("_first"), F.any_value("_bands").alias("_bands")
    )
    nodes = materialised(nodes, "nodes")
    banded = nodes.select("_key", F.explode("_bands").alias("_band"))
    buckets = banded.groupBy("_band").agg(F.min("_key").alias("_hub"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    grouped = materialised(components(banded.join(buckets, "_band").select(F.col("_key").alias("a"), F.col("_hub").alias("b"))), "groups")

    size = grouped.groupBy("root").agg((F.count("*") + 1).alias("_size"))
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    members = (
        grouped.unionByName(roots).join(size, "root")
        .join(nodes.select(F.col("_key").alias("node"), "_copies", F.col("_first.row").alias("_row")), "node")
        .withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    )
    # Members grow with the corpus, so they are merged with the texts at any size, never broadcast.
    found = members.hint("merge").join(texts.select("_row", "text"), "_row")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    cells = found.withColumn("_other", other).select(
        "root", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "node", "_block", "_copies", "text"
    )
    place = ["root", "_low", "_high"]
    linked = cells.repartition(*place).sortWithinPartitions(*place).mapInArrow(
        _verify(words, threshold), "_key binary, _tie binary, n_classes long, n_docs long"
    )
    linked = materialised(linked, "links")

    connected = components(linked.select(F.col("_key").alias("a"), F.col("_tie").alias("b")))
    counts = linked.groupBy("_key").agg(F.sum("n_classes").alias("_t"), F.sum("n_docs").alias("_d"))
    rooted = (
        nodes.drop("_bands").join(connected.withColumnRenamed("node", "_key"), "_key", "left").join(counts, "_key", "left")
        .withColumn("_root", F.coalesce("root", "_key"))
    )
    rooted = materialised(rooted, "rooted")
    classes = rooted.groupBy("_root").agg(F.min("_first").alias("_class"))
    result = rooted.join(classes, "_root").select(
        "_key", F.col("_class.doc_id").alias("class_id"), F.col("_class.row").alias("_class_row"), F.col("_first.doc_id").alias("copy_of"),
        (F.coalesce("_d", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("_t", F.lit(0)).alias("n_text_links"),
    )
    wordless = F.col("_key").isNull()
    return light.drop("_bands").join(result, "_key", "left").select(
        "doc_id",
        F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        "_row", F.coalesce("_class_row", "_row").alias("_class_row"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` in their own columns, one of each class: that with the smallest doc_id."""
    kept = join(docs, threshold).where("_row = _class_row").select("_row").distinct()
    return with_row_key(docs).join(kept.hint("merge"), "_row").dropDuplicates(["_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select("doc_id", "class_id", "copy_of", "n_links", "n_text_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_ngram_join": op4_ngram_join}
