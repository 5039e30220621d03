"""Token ids in binary shards, found by document key through minimal perfect hash indexes.

Layout of a store below its folder:

- ``shards/<range>-<number>.ids``: magic, version, bytes per id (2 if the vocabulary allows it, else 4), number
  of ids, then the ids little-endian, documents by ascending id one behind the other;
- ``index/<part>.mph``: the keys of one part of the hash space, each found in constant time: levels of bit arrays
  give a key its slot, a slot holds the key's fingerprint, shard, offset and length;
- ``shards.parquet``: for each shard, how many ids all shards before it hold.

A key is a document id and its ordinal among rows of that id, so repeated ids stay apart.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.byte_chunks import worker_bytes
from fieldtrust.llm.common import fresh_path, slices, slices_by_bytes, table, tokenizer_path, whole_text
from fieldtrust.llm.files import place, read_file, write_file
from fieldtrust.llm.ranges import in_ranges

MAGIC, VERSION = b"TOKS", 1
#: Magic, version, bytes per id, number of ids.
HEADER = "<4sHHQ"
#: Bytes of ids per shard from which the next document opens a new one.
SHARD_BYTES = 64 << 20
#: Keys of an index part, on average.
PART_KEYS = 50_000
END = 0
#: Bits per key of a level, and most levels; keys that no level places are kept in a list.
GAMMA, LEVELS = 2.0, 40


def key_hash(doc_id: int | None, ordinal: int) -> tuple[int, int]:
    """128 bits as two signed numbers: keys that share them are not to be expected in any corpus."""
    return struct.unpack("<2q", xxhash.xxh3_128_digest(f"{'' if doc_id is None else doc_id}#{ordinal}"))


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key (two columns) for a level; keys that share one half part on another level."""
    x = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (rows of two unsigned numbers): n keys get the slots 0 to n - 1.

    On each level a key that no other one meets at its bit sets it; the others go on to the next level.
    A key's slot is the number of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bits as bytes of 0 and 1; keys without a level
        counts = [0, *np.cumsum([int(bits.sum()) for bits in levels]).tolist()]
        self.ranks = [start + np.cumsum(bits) - bits for start, bits in zip(counts, (b.astype("i8") for b in levels))]
        self.placed = counts[-1]
        self._listed = {key: self.placed + i for i, key in enumerate(map(tuple, rest.tolist()))}

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA, most: int = LEVELS) -> PerfectHash:
        levels, left = [], np.unique(keys, axis=0)
        if len(left) < len(keys):
            raise ValueError("keys are not distinct")
        while len(left) and len(levels) < most:
            size = max(64, int(gamma * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype("i8")
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype("u1"))
            left = left[~alone[at]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets any slot, or -1."""
        out = np.full(len(keys), -1, "i8")
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype("i8")
            hit = bits[at] == 1
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        if self._listed:
            out[open_] = [self._listed.get(key, -1) for key in map(tuple, keys[open_].tolist())]
        return out


class IndexPart:
    """Fingerprint, shard, offset and length by slot."""

    def __init__(self, hashing: PerfectHash, columns: dict[str, np.ndarray]):
        self.hashing, self.columns = hashing, columns

    @classmethod
    def build(cls, keys: np.ndarray, shards: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> IndexPart:
        hashing = PerfectHash.build(keys)
        slots = hashing.slots(keys)
        columns = {}
        for name, kind, values in (
            ("print", "<u4", _mix(keys, LEVELS + 1) >> np.uint64(32)), ("shard", "<u8", shards), ("offset", "<u8", offsets), ("length", "<u8", lengths)
        ):
            columns[name] = np.zeros(len(keys), kind)
            columns[name][slots] = values
        return cls(hashing, columns)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is in the part, by its fingerprint, and its shard, offset and length."""
        slots = self.hashing.slots(keys)
        size = len(self.columns["print"])
        safe = np.clip(slots, 0, max(0, size - 1))
        if not size:
            return np.zeros(len(keys), bool), {n: np.zeros(len(keys), c.dtype) for n, c in self.columns.items()}
        found = (slots >= 0) & (self.columns["print"][safe] == (_mix(keys, LEVELS + 1) >> np.uint64(32)))
        return found, {n: c[safe] for n, c in self.columns.items()}

    def dump(self) -> bytes:
        packed = [np.packbits(bits).tobytes() for bits in self.hashing.levels]
        head = struct.pack("<4sHHQQ", MAGIC, VERSION, len(packed), len(self.columns["print"]), len(self.hashing.rest))
        sizes = struct.pack(f"<{len(packed)}Q", *[len(bits) for bits in self.hashing.levels])
        return b"".join([head, sizes, *packed, self.hashing.rest.astype("<u8").tobytes(), *[c.tobytes() for c in self.columns.values()]])

    @classmethod
    def load(cls, raw: bytes) -> IndexPart:
        magic, version, n_levels, size, rest = struct.unpack_from("<4sHHQQ", raw)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not an index part")
        at = struct.calcsize("<4sHHQQ")
        sizes = struct.unpack_from(f"<{n_levels}Q", raw, at)
        at += 8 * n_levels
        levels = []
        for bits in sizes:
            width = (bits + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, "u1", width, at), count=bits))
            at += width
        left = np.frombuffer(raw, "<u8", 2 * rest, at).reshape(rest, 2)
        at += 16 * rest
        columns = {}
        for name, kind in (("print", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("length", "<u8")):
            columns[name] = np.frombuffer(raw, kind, size, at)
            at += size * columns[name].itemsize
        return cls(PerfectHash(levels, left), columns)


def shard_name(path: str, shard: int) -> str:
    return f"{path}/shards/{shard >> 32:06d}-{shard & 0xFFFFFFFF:06d}.ids"


def _write_shards(path: str, vocabulary: str, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows arrive range by range in the order of their ids; puts out where each went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_bytes(vocabulary)
        width = np.dtype(encoder.kind).itemsize
        end = np.array([END], encoder.kind).tobytes()
        place_, ordinal, before, number = None, 0, None, 0
        held: list[bytes] = []
        size = 0

        def close() -> None:
            if held:
                write_file(shard_name(path, (place_ << 32) + number), b"".join([struct.pack(HEADER, MAGIC, VERSION, width, size // width), *held]))

        for batch in slices_by_bytes(batches, "text"):
            out: list[tuple] = []
            encoded = encoder.ids(batch.column("text"))
            for range_, doc_id, ids in zip(batch.column("_range").to_pylist(), batch.column("doc_id").to_pylist(), encoded):
                if range_ != place_:
                    close()
                    place_, number, held, size, ordinal, before = range_, 0, [], 0, 0, ()
                elif size >= shard_bytes:
                    close()
                    number, held, size = number + 1, [], 0
                ordinal = ordinal + 1 if doc_id == before else 0
                before = doc_id
                length = len(ids) // width + 1
                out.append((doc_id, ordinal, *key_hash(doc_id, ordinal), (place_ << 32) + number, size // width, length))
                held += (ids, end)
                size += length * width
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "ordinal", "key", "check", "shard", "offset", "length"])
        close()

    return run


def _keys(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy() for c in ("key", "check")]).astype("i8").view("u8")


def _write_index(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows arrive part by part; puts out the size of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            number = rows.column("part")[0].as_py()
            part = IndexPart.build(_keys(rows), *[rows.column(c).to_numpy() for c in ("shard", "offset", "length")])
            write_file(f"{path}/index/{number:08d}.mph", part.dump())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows.num_rows], pa.int64())], ["part", "keys"])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[0].column("part")[0].as_py() != parts[a]:
                    yield close()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return run


def part_of(parts: int) -> Column:
    return F.pmod(F.col("key"), F.lit(parts)).cast("long")


def write_store(docs: DataFrame, path: str, vocabulary: str, shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS) -> int:
    """Encodes ``docs`` (doc_id long, text) and writes the store to ``path``; returns its number of index parts.

    Documents are in the order of their ids, null ids first, rows of one id by the hash of their texts.
    Each ends with id 0. A null text is empty. Extra columns are ignored; an empty table gives a store without shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = in_ranges(rows).withColumn("_hash", F.xxhash64("text"))
    ordered = rows.repartition("_range").sortWithinPartitions("_range", F.col("doc_id").asc_nulls_first(), "_hash")
    schema = "doc_id long, ordinal long, key long, check long, shard long, offset long, length long"
    ordered.mapInArrow(_write_shards(path, vocabulary, shard_bytes), schema).write.parquet(f"{path}/directory.parquet")
    directory = spark.read.schema(schema).parquet(f"{path}/directory.parquet")
    parts = max(1, -(-directory.count() // part_keys))
    placed = directory.withColumn("part", part_of(parts)).select("part", "key", "check", "shard", "offset", "length")
    placed.repartition("part").sortWithinPartitions("part").mapInArrow(_write_index(path), "part long, keys long").write.parquet(f"{path}/parts.parquet")
    # A row per shard; ranges have disjoint ids, so a shard's documents follow all those of the shards before.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = directory.groupBy("shard").agg(F.sum("length").alias("ids"))
    shards.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{path}/shards.parquet")
    return parts


def _look_up(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys arrive part by part; puts out those that the index has, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = None, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts[a] != number:
                    number, part = parts[a], IndexPart.load(read_file(f"{path}/index/{parts[a]:08d}.mph"))
                rows = batch.slice(a, b - a)
                found, places = part.find(_keys(rows))
                columns = [rows.column("doc_id").filter(pa.array(found))]
                columns += [pa.array(places[c][found].astype("i8")) for c in ("shard", "offset", "length")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "offset", "length"])

    return run


def _key_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ordinals = batch.column("doc_id"), batch.column("ordinal")
        keys = np.array([key_hash(i, o) for i, o in zip(ids.to_pylist(), ordinals.to_pylist())], "i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, keys.T)], ["doc_id", "key", "check"])


def look_up(keys: DataFrame, path: str, parts: int) -> DataFrame:
    """doc_id, shard, offset and length of each of ``keys`` (doc_id, ordinal) that the store has."""
    hashed = keys.select("doc_id", F.col("ordinal").cast("long")).mapInArrow(_key_hashes, "doc_id long, key long, check long")
    placed = hashed.withColumn("part", part_of(parts)).repartition("part").sortWithinPartitions("part")
    return placed.mapInArrow(_look_up(path), "doc_id long, shard long, offset long, length long")


def _read_shards(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places arrive shard by shard in the order of their offsets; puts out the payload of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, width, header = None, None, 0, struct.calcsize(HEADER)
        for batch in slices(batches):
            payloads = []
            for number, offset, length in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")]):
                if number != shard:
                    if file is not None:
                        file.close()
                    system, name = place(shard_name(path, number))
                    shard, file = number, system.open_input_file(name)
                    magic, version, width, _ = struct.unpack(HEADER, file.read(header))
                    if (magic, version) != (MAGIC, VERSION):
                        raise ValueError(f"not a shard: {name}")
                file.seek(header + offset * width)
                payloads.append(np.frombuffer(file.read(length * width), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "shard", "offset", "length")] + [pa.array(payloads, pa.binary())],
                ["doc_id", "shard", "offset", "length", "ids"],
            )

    return run


def read_documents(keys: DataFrame, path: str, parts: int) -> DataFrame:
    """doc_id, start, length and ids (little-endian unsigned 32-bit integers, with the end id) of ``keys`` from the files."""
    places = look_up(keys, path, parts).repartition("shard").sortWithinPartitions("shard", "offset")
    read = places.mapInArrow(_read_shards(path), "doc_id long, shard long, offset long, length long, ids binary")
    first = keys.sparkSession.read.schema("shard long, ids long, first long").parquet(f"{path}/shards.parquet").drop("ids")
    return read.join(first, "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "length", "ids")


def every_key(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal) of every row of ``docs``."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("_n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("ordinal"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "token-store")
    parts = write_store(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(every_key(docs), path, parts).select(
        "doc_id", "start", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_token_store": op10_token_store}
