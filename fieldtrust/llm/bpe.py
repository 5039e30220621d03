"""BPE encoding and decoding by tree concatenation, equal to the library's own on whole texts.

A text is cut in halves down to leaves; leaves are encoded on their own and joined upwards. A join
re-encodes a window around the cut, wider and wider, until its first segment is one the left side
has and its last one the right side has; between them the window's ids replace both sides' own.

Why that is exact: a sequence of BPE tokens is the encoding of its text when every pair of
neighbours is, so two encodings that share a token at one place can be spliced there. A segment
is either a whole chunk (a blank and what follows up to the next blank that a visible character
follows; such a blank always begins a new word, so no merge crosses it) or, inside a chunk too long
to be kept in a table, a token. Control strings such as <|endoftext|> are found in raw text, so a
window reaches at least their length to either side.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import slices, table, tokenizer_path, whole_text

#: Code points of a leaf, and of a piece that is a task's row of its own.
LEAF = 4096
PIECE = 1 << 16
#: Longest chunk that is looked up in the table of chunks, and most chunks in each of its two generations.
CHUNK = 64
TABLE = 300_000

#: Texts of consecutive segments, and the ids of each as little-endian unsigned 32-bit integers.
Segments = tuple[list[str], list[bytes]]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class TreeEncoder:
    """Encodes texts with one vocabulary file. A chunk met before is looked up instead of merged again."""

    _CUT = re.compile(r"(?= [!-~À-ɏ])")
    _CHUNK = re.compile(r" [!-~À-ɏ]")

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = max(1, leaf)
        self.reach = max([1, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        # Ids of chunks. When the young generation is full it becomes the old one; what is met again returns.
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return b"".join(self.segments(text)[1])

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    def segments(self, text: str) -> Segments:
        if len(text) <= self.leaf:
            return self._flat(text)
        middle = len(text) // 2
        return self.join(self.segments(text[:middle]), self.segments(text[middle:]))

    def join(self, left: Segments, right: Segments) -> Segments:
        if not left[0] or not right[0]:
            return left if left[0] else right
        width = 1
        while True:
            width *= 2
            before, after = "".join(left[0][-width:]), "".join(right[0][:width])
            all_left, all_right = width >= len(left[0]), width >= len(right[0])
            texts, ids = self._flat(before + after)
            at_left = all_left or (len(before) >= self.reach and (texts[0], ids[0]) == (left[0][-width], left[1][-width]))
            at_right = all_right or (len(after) >= self.reach and (texts[-1], ids[-1]) == (right[0][width - 1], right[1][width - 1]))
            if at_left and at_right and (len(texts) > 1 or all_left or all_right):
                for side, window, other in ((left[0], texts, right[0]), (left[1], ids, right[1])):
                    side[-width:] = window
                    side += other[width:]
                return left

    def _flat(self, text: str) -> Segments:
        """Segments of a text without cutting it in halves."""
        texts = self._cut(text) if "\0" in text else text.replace(" ", "\0 ").split("\0")
        if not texts[0]:
            del texts[0]
        ids: list[bytes | None] = list(map(self._young.get, texts))
        if None in ids:
            missing = [t for t, known in zip(texts, ids) if known is None]
            if not all(map(self._CHUNK.match, missing[ids[0] is None :])):
                texts = self._cut(text)
                missing = texts
            self._learn(missing)
            ids = list(map(self._young.get, texts))
            if None in ids:  # too long for the table, or gone to the old generation
                self._learn([t for t, known in zip(texts, ids) if known is None])
                ids = list(map(self._young.get, texts))
                if None in ids:
                    return self._with_tokens(texts, ids)
        return texts, ids

    def _cut(self, text: str) -> list[str]:
        return [c for c in self._CUT.split(text) if c] or [""]

    def _learn(self, chunks: list[str]) -> None:
        """Puts chunks into the table, but those too long for it; only the first may begin without a blank."""
        if len(self._young) + len(chunks) > TABLE:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        new = []
        for chunk in dict.fromkeys(chunks):
            if chunk in young or len(chunk) > CHUNK:
                continue
            ids = old.get(chunk)
            if ids is None:
                new.append(chunk)
            else:
                young[chunk] = ids
        young.update(zip(new, self._encoded(new)))

    def _encoded(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk: one text to the library, cut afterwards."""
        if not chunks:
            return
        encoding = self.tokenizer.encode("".join(chunks), add_special_tokens=False)
        ids, offsets = packed(encoding.ids), encoding.offsets
        first = at = end = 0
        for chunk in chunks:
            end += len(chunk)
            while at < len(offsets) and offsets[at][0] < end:
                at += 1
            yield ids[4 * first : 4 * at]
            first = at

    def _with_tokens(self, texts: list[str], ids: list[bytes | None]) -> Segments:
        """The segments, with those of its tokens for each chunk too long for the table."""
        out: Segments = ([], [])
        for text, known in zip(texts, ids):
            more = ([text], [known]) if known is not None else self._tokens(text)
            out[0].extend(more[0])
            out[1].extend(more[1])
        return out

    def _tokens(self, text: str) -> Segments:
        """A segment per token; tokens that share a character stay together, dropped blanks go with what follows."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        ends: list[int] = []
        tokens: list[list[int]] = []
        for token, (start, end) in zip(encoding.ids, encoding.offsets):
            if ends and start < ends[-1]:
                ends[-1] = max(end, ends[-1])
                tokens[-1].append(token)
            else:
                ends.append(end)
                tokens.append([token])
        if not ends:
            return [text], [b""]
        ends[-1] = len(text)
        return [text[a:b] for a, b in zip([0, *ends], ends)], [packed(t) for t in tokens]


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> TreeEncoder:
    """The encoder of this Python worker, whose table of chunks the tasks that it runs fill together."""
    return TreeEncoder(path)


def _whole(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches):
            ids = [encoder.ids(t) for t in batch.column("text").to_pylist()]
            yield _rows(batch.column("doc_id"), ids, encoder)

    return run


def _rows(doc_ids: pa.Array, ids: list[bytes], encoder: TreeEncoder) -> pa.RecordBatch:
    decoded = pa.array([encoder.decode(i) for i in ids], pa.string())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), decoded], ["doc_id", "ids", "decoded"])


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches):
            found = [encoder.segments(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_hash"), batch.column("_piece"),
                    pa.array([texts for texts, _ in found], pa.list_(pa.string())),
                    pa.array([ids for _, ids in found], pa.list_(pa.binary())),
                ],
                ["doc_id", "_hash", "_piece", "texts", "ids"],
            )

    return run


def _joined(path: str) -> Callable[[pa.Table], pa.Table]:
    def run(pieces: pa.Table) -> pa.Table:
        encoder = worker_encoder(path)
        pieces = pieces.sort_by("_piece")
        numbers = pieces.column("_piece").to_pylist()
        copies = numbers.count(0)
        texts, ids = pieces.column("texts"), pieces.column("ids")
        parts = [(texts[i].as_py(), ids[i].as_py()) for i in range(0, len(numbers), copies)]
        while len(parts) > 1:
            parts = [encoder.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        whole = b"".join(parts[0][1])
        doc_ids = pieces.column("doc_id").combine_chunks().slice(0, copies)
        return pa.Table.from_batches([_rows(doc_ids, [whole] * copies, encoder)])

    return run


def encode(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the text decoded from them, for each row.

    Texts of more than ``piece`` code points are cut into rows of their own, which other tasks
    encode; only their segments meet again, one document to a group. A null text is encoded as
    the empty one, which has no ids and decodes to the empty text. Repeated rows stay repeated;
    columns besides doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, ids binary, decoded string"
    rows = docs.select("doc_id", whole_text().alias("text"))
    short = rows.where(F.length("text") <= piece).mapInArrow(_whole(path), out)
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")))
    pieces = (
        rows.where(F.length("text") > piece)
        .withColumns({"_hash": F.sha2("text", 256), "_piece": cut})
        .withColumn("text", F.substring("text", F.col("_piece") * piece + 1, F.lit(piece)))
        .repartition("doc_id", "_piece")
        .mapInArrow(_pieces(path), f"doc_id {kind}, _hash string, _piece int, texts array<string>, ids array<binary>")
    )
    return short.unionByName(pieces.groupBy("doc_id", "_hash").applyInArrow(_joined(path), out))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, tokenizer_path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_bpe_round_trip": op3_bpe_round_trip}
