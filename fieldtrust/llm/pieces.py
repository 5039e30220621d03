"""SentencePiece encoding and decoding with the place of every piece in the original bytes.

A text is normalised from left to right: at each place the longest key of the model's compiled character map (a
double-array trie) is replaced, a character that begins no key stays. Along with it goes the source offset of every
normalised byte, so a piece's normalised bytes lead back to the bytes of the original text. Pieces are found in the
normalised text by the library, to which the model is given without its own normalisation.

Where no piece of the vocabulary goes on from some other character to a word's beginning (U+2581), no merge does either,
so long texts are encoded in parts that end before such a place; memory then does not grow with the number of merges of
a whole text. Whether the vocabulary is like that is checked when it is loaded.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import slices, table, tokenizer_path, whole_text

#: What stands for a blank in pieces, and for bytes that are no character (fixed values of the format).
SPACE, REPLACEMENT = "▁", "�"
#: Kinds of pieces and of models (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Characters of a normalised text after which it is cut at the next word.
PART = 1 << 16


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if size is None else size
        yield tag >> 3, raw[at : at + size]
        at += size


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _message(*fields: tuple[int, int | bytes]) -> bytes:
    """A protocol buffer message of the fields (numbers, and bytes with their length)."""
    return b"".join(
        _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value
        for number, value in fields
    )


class CharacterMap:
    """A compiled character map: the trie's units, then the replacements, each ended by a zero byte."""

    def __init__(self, raw: bytes):
        size = struct.unpack_from("<I", raw)[0] if raw else 0
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = raw[4 + size :]
        self._begins: dict[str, bool] = {}

    def longest(self, source: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest key that ``source`` has at ``at``, and its replacement; (0, None) without one.

        A unit holds the label of the edge to it, whether a leaf follows, and the offset of its children.
        """
        units, found = self.units, (0, -1)
        node = _children(units[0], 0)
        for length, byte in enumerate(memoryview(source)[at:], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            leaf, node = units[node] >> 8 & 1, _children(units[node], node)
            if leaf:
                found = (length, units[node] & 0x7FFFFFFF)
        length, value = found
        if not length:
            return 0, None
        return length, self.replacements[value : self.replacements.index(b"\0", value)]

    def begins(self, character: str) -> bool:
        """Whether some key may begin with the character."""
        known = self._begins.get(character)
        if known is None:
            node, known = _children(self.units[0], 0), True
            for byte in character.encode():
                node ^= byte
                if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                    # A key that ends inside a character is possible in the format.
                    known = self.longest(character.encode(), 0)[0] > 0
                    break
                node = _children(self.units[node], node)
            self._begins[character] = known
        return known


def _children(unit: int, node: int) -> int:
    return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class PieceEncoder:
    """Encodes and decodes texts with one model file. Only BPE models with bytes for unknown characters are taken."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._open(file.read())

    @classmethod
    def of(cls, model: bytes) -> PieceEncoder:
        """The encoder of a model held in memory."""
        encoder = cls.__new__(cls)
        encoder._open(model)
        return encoder

    def _open(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        fields = list(_fields(model))
        trainer, norm = (dict(_fields(next((v for n, v in fields if n == number), b""))) for number in (2, 3))
        if trainer.get(3, 1) != BPE or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback are supported")
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24))
        pieces = [dict(_fields(v)) for n, v in fields if n == 1]
        texts, kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        self.library = SentencePieceProcessor(model_proto=model)
        # The same pieces, with texts taken as they are.
        plain = _message((1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0))
        self._plain = SentencePieceProcessor(model_proto=_message(*[(n, plain if n == 3 else v) for n, v in fields], *[(3, plain)] * (not norm)))
        self.own = sorted((t for t, k in zip(texts, kinds) if k == USER_DEFINED), key=len, reverse=True)
        # Bytes of each piece in normalised texts, and what it is decoded to (None: left to the library).
        self.normal = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() for t, k in zip(texts, kinds)]
        self.sizes = np.array([len(b) for b in self.normal], "i8")
        self._decoded = [t.replace(SPACE, " ").encode() if k in (NORMAL, USER_DEFINED, UNUSED) else b if k == BYTE else None for t, k, b in zip(texts, kinds, self.normal)]
        self._bytes = {i for i, k in enumerate(kinds) if k == BYTE}
        merged = [t for t, k in zip(texts, kinds) if k not in (BYTE, CONTROL, UNKNOWN) and len(t) > 1]
        alone = SPACE in texts and not self.own and not any(SPACE in t.lstrip(SPACE) for t in merged)
        self._next = re.compile(f"(?<=[^{SPACE}]){SPACE}") if alone else None

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the offset in the UTF-8 bytes of ``text``."""
        if not text:
            return "", np.zeros(1, "i8")
        if self.map.units or self.squeeze or self.own or self.suffix:
            return self._mapped(text)
        raw = np.frombuffer(text.encode(), "u1")
        place = np.arange(len(raw))
        if not text.isascii():
            place = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, place, 0))
        wide = len(SPACE.encode()) if self.escape else 1
        if wide > 1:
            place = np.repeat(place, np.where(raw == 0x20, wide, 1))
        ahead = np.zeros(wide * self.prefix, "i8")
        blank = SPACE if self.escape else " "
        return blank * self.prefix + (text.replace(" ", SPACE) if self.escape else text), np.concatenate([ahead, place, [len(raw)]])

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        """``normalised`` by the character map, one replacement at a time."""
        source, blank = text.encode(), (SPACE if self.escape else " ").encode()
        out: list[bytes] = []
        begins: list[int] = []

        def put(piece: bytes, begin: int) -> None:
            for part in re.split(b"( )", piece):
                if part:
                    out.append(blank if part == b" " else part)
                    begins.append(begin)

        at = 0
        while self.squeeze and at < len(source):  # blanks at the beginning go
            length, piece = self._longest(source, at)
            if piece != b" ":
                break
            at += length
        if at == len(source):
            return "", np.array([at], "i8")
        if self.prefix and not self.suffix:
            put(b" ", at)
        after_blank = self.squeeze
        while at < len(source):
            length, piece = self._longest(source, at)
            if after_blank:
                piece = piece.lstrip(b" ")
            put(piece, at)
            if piece:
                after_blank = self.squeeze and piece.endswith(b" ")
            at += length
        while self.squeeze and out and out[-1] == blank:
            out.pop()
            at = begins.pop()
        if self.prefix and self.suffix:
            put(b" ", at)
        return b"".join(out).decode(), np.append(np.repeat(np.array(begins, "i8"), [len(o) for o in out]), at)

    def _longest(self, source: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes are replaced next, and by what."""
        for piece in self.own:
            if source.startswith(piece.encode(), at):
                return len(piece.encode()), piece.encode()
        lead = source[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        character = source[at : at + width]
        if self.map.units:
            try:
                known = self.map.begins(character.decode())
            except UnicodeDecodeError:  # after a key that ended inside a character
                known = True
            if known:
                length, piece = self.map.longest(source, at)
                if length:
                    return length, piece
        try:
            character.decode()
        except UnicodeDecodeError:
            return 1, REPLACEMENT.encode()
        return width, character

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the offsets in the UTF-8 bytes of ``text`` where pieces begin and the last one ends.

        A character spelled in byte pieces belongs to the last of them; one that the normalisation put in has no bytes.
        """
        normal, places = self.normalised(text)
        ids = self.ids_of(normal)
        ends = np.zeros(len(ids) + 1, "i8")
        np.cumsum(self.sizes[ids], out=ends[1:])
        return ids, places[ends]

    def ids_of(self, normal: str, part: int = PART) -> np.ndarray:
        """Ids of a normalised text, cut about every ``part`` characters."""
        if self._next is None or len(normal) <= part:
            return np.asarray(self._plain.encode(normal, return_type="numpy"), "<u4")
        found, at = [], 0
        while at < len(normal):
            cut = self._next.search(normal, at + part)
            end = cut.start() if cut else len(normal)
            found.append(np.asarray(self._plain.encode(normal[at:end], return_type="numpy"), "<u4"))
            at = end
        return np.concatenate(found)

    @property
    def by_words(self) -> bool:
        """Whether a text's words are encoded apart: blanks become U+2581 and nothing else is normalised, and no piece goes on into the next word."""
        return self._next is not None and self.prefix and self.escape and not (self.map.units or self.squeeze or self.suffix)

    def ids_of_words(self, normals: list[str]) -> list[list[int]]:
        """Ids of each of many short normalised texts."""
        return self._plain.encode(normals, num_threads=1)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes them."""
        listed = ids.tolist()
        parts = list(map(self._decoded.__getitem__, listed))
        if not parts:
            return ""
        if not self.squeeze and not self.suffix and listed[0] not in self._bytes and None not in parts:
            if self.prefix and parts[0].startswith(b" "):
                parts[0] = parts[0][1:]
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(listed)


@lru_cache(maxsize=2)
def worker_pieces(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    return PieceEncoder(path)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_pieces(path)
        for batch in slices(batches):
            ids, edges, decoded = [], [], []
            for text in batch.column("text"):
                found, places = encoder.encode(text.as_py())
                ids.append(found.tobytes())
                edges.append(places.astype("<u4").tobytes())
                decoded.append(encoder.decode(found))
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(edges, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "edges", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, edges and decoded of each row of ``docs`` (doc_id, text); row-local, nothing is shuffled.

    ``ids`` and ``edges`` are little-endian unsigned 32-bit integers: piece i stands for the bytes from edge i to edge
    i + 1 of the text in UTF-8. A null text is encoded as the empty one, which has no ids, one edge and decodes to the
    empty text. Repeated rows stay repeated; other columns are ignored, also such with the names put out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_encode(path), f"doc_id {kind}, ids binary, edges binary, decoded string")


def _decimal_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        listed = (np.frombuffer(raw.as_py(), "<u4").tolist() for raw in batch.column("ids"))
        found = pa.array([hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in listed], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), found, *batch.columns[3:]], batch.schema.names[:2] + ["ids_sha256"] + batch.schema.names[3:])


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids (decimal, joined by commas), decoded text and edges."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.sha2("edges", 256).alias("edges_sha256"),
    )
    return rows.mapInArrow(_decimal_digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, edges_sha256 string")


def op11_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, tokenizer_path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_sentencepiece_offsets": op11_sentencepiece_offsets}
