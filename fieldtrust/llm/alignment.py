"""Aligning two tokenizers' tokens over the same bytes by merge-path partitioning.

The byte offsets where A's tokens end and those where B's tokens end are two sorted lists. Every distinct end closes one
overlap of an A and a B token (a link), every common end closes a group. Merging the lists finds both. Diagonals cut the
merge into pieces of equal work: on diagonal d, a binary search finds how many of the first d ends are A's. A piece
needs nothing of the others, so it is a row that any task can merge; ties are never cut. It puts out its links, the groups
that lie inside, and what is open at its two sides, from which the pieces of a document are stitched.

How often an id pair is linked, counted in documents, comes from all blocks of documents: a block puts out its distinct
pairs, their counts are summed over the corpus, and what a block needs of the sums comes back to it as one sorted file.
Neither tokens nor links are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.byte_chunks import CHUNK, ByteEncoder
from fieldtrust.llm.common import fresh_path, materialised, slices, table, tokenizer_path, whole_text
from fieldtrust.llm.files import read_file, write_file
from fieldtrust.llm.pieces import SPACE, PieceEncoder

#: Ends merged by a piece, and ends in a block of documents that one file of pair counts serves.
STEPS, BLOCK_STEPS = 1 << 18, 1 << 24
#: Words whose pieces a worker keeps for look-up.
WORDS = 600_000
#: Distinct pairs that a task holds before it puts them out.
HELD = 1 << 21

PIECES = "block long, key long, doc_id {kind}, piece int, pieces int, n_a long, n_b long, a_at long, b_at long, a binary, b binary"
PAIRS = "block long, code long, n long, key long"
SCORED = (
    "key long, doc_id {kind}, piece int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, head_a string, head_b string, body string, tail_a string, tail_b string"
)
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabularies:
    """Both tokenizers, and for each id its bytes, their number and its decimal forms."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteEncoder(path_a, plain_controls=True), PieceEncoder(path_b)
        self.bytes_a, self.bytes_b = self.a.bytes, [p.replace(SPACE.encode(), b" ") for p in self.b.normal]
        self.length_a, self.length_b = (np.array([len(e) for e in v], "i8") for v in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.kind_a, self.kind_b = self.a.kind, "<u2" if self.n_b <= 1 << 16 else "<u4"
        self._words: dict[str, bytes] = {}
        # Decimal forms with what follows: A inside and at the end of its part of a group, B likewise.
        self.forms = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers for each text; none where either's bytes are not those of a space and the text."""
        cut = self.a.chunks([f" {text}" for text in texts])
        out = []
        for text, (_, found), b in zip(texts, cut, self._pieces(texts, [chunks for chunks, _ in cut])):
            raw = f" {text}".encode()
            # A's chunks give their bytes back, or their encoder would have raised.
            if text and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw:
                out.append((np.frombuffer(b"".join(found), self.kind_a), b))
            else:
                out.append((np.zeros(0, self.kind_a), np.zeros(0, self.kind_b)))
        return out

    def _pieces(self, texts: list[str], cut: list[list[str]]) -> list[np.ndarray]:
        """B's ids. A's chunks are looked up where each begins with the one blank before a word; other texts are encoded as a whole."""
        if len(self._words) > WORDS:
            self._words = {}
        words = self._words
        apart = [self.b.by_words and "  " not in text and not text.startswith(" ") and SPACE not in text for text in texts]
        new = list(dict.fromkeys(c for chunks, by_chunk in zip(cut, apart) if by_chunk for c in chunks if c not in words))
        form = "H" if self.kind_b == "<u2" else "I"
        found = {c: struct.pack(f"<{len(ids)}{form}", *ids) for c, ids in zip(new, self.b.ids_of_words([c.replace(" ", SPACE) for c in new]))}
        long = {c: found.pop(c) for c in new if len(c) > CHUNK}
        words.update(found)
        out = []
        for text, chunks, by_chunk in zip(texts, cut, apart):
            if by_chunk:
                raw = b"".join([words[c] if c in words else long[c] for c in chunks])
                out.append(np.frombuffer(raw, self.kind_b))
            else:
                out.append(self.b.ids_of(self.b.normalised(text)[0]).astype(self.kind_b))
        return out


@lru_cache(maxsize=2)
def worker_vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def split(ends_a: np.ndarray, ends_b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of the first ``diagonal`` ends in the merged order are A's and B's. Of equal ends A's comes first, and B's is not left behind."""
    low, high = max(0, diagonal - len(ends_b)), min(diagonal, len(ends_a))
    while low < high:
        middle = (low + high) // 2
        if ends_b[diagonal - middle - 1] < ends_a[middle]:
            high = middle
        else:
            low = middle + 1
    i, j = low, diagonal - low
    if i and j < len(ends_b) and ends_a[i - 1] == ends_b[j]:
        j += 1
    return i, j


class Piece(NamedTuple):
    """Ids of a piece with the one after them, how many are its own, and the offsets where the first ones begin."""

    a: np.ndarray
    b: np.ndarray
    n_a: int
    n_b: int
    a_at: int
    b_at: int


def cut(a: np.ndarray, b: np.ndarray, vocab: Vocabularies, steps: int = STEPS) -> list[Piece]:
    """The pieces of a document's merge; one without ids for a document without."""
    total = len(a) + len(b)
    if total <= steps:
        return [Piece(a, b, len(a), len(b), 0, 0)]
    ends_a, ends_b = np.cumsum(vocab.length_a[a]), np.cumsum(vocab.length_b[b])
    places = [split(ends_a, ends_b, d) for d in range(0, total, steps)] + [(len(a), len(b))]
    start = lambda ends, i: int(ends[i - 1]) if i else 0
    return [
        Piece(a[i : i2 + 1], b[j : j2 + 1], i2 - i, j2 - j, start(ends_a, i), start(ends_b, j))
        for (i, j), (i2, j2) in zip(places, places[1:])
        if (i, j) != (i2, j2)
    ]


class Merged(NamedTuple):
    """Links by the end that closes them, and where both sides end."""

    links_a: np.ndarray  # code of the pair that each A end closes
    links_b: np.ndarray  # and each B end that is not an A end as well
    tied_a: np.ndarray
    tied_b: np.ndarray


def merge(piece: Piece, vocab: Vocabularies) -> Merged:
    ends_a = piece.a_at + np.cumsum(vocab.length_a[piece.a[: piece.n_a]])
    ends_b = piece.b_at + np.cumsum(vocab.length_b[piece.b[: piece.n_b]])
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    tied_a, tied_b = np.zeros(piece.n_a, bool), np.zeros(piece.n_b, bool)
    inside = over_a < piece.n_b
    tied_a[inside] = ends_b[over_a[inside]] == ends_a[inside]
    tied_b[over_a[tied_a]] = True
    open_b = np.flatnonzero(~tied_b)
    a, b = piece.a.astype("i8"), piece.b.astype("i8")
    return Merged(a[: piece.n_a] * vocab.n_b + b[over_a], a[over_b[open_b]] * vocab.n_b + b[open_b], tied_a, tied_b)


def written_groups(piece: Piece, merged: Merged, vocab: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the decimal forms of all ids in the order of the groups' text, and for each A id its place in it, one more at the end."""
    last_a, last_b = np.flatnonzero(merged.tied_a), np.flatnonzero(merged.tied_b)
    # Groups before each id: ends before it that both sides share.
    group_a = np.cumsum(merged.tied_a) - merged.tied_a
    group_b = np.cumsum(merged.tied_b) - merged.tied_b
    before_b = np.concatenate([[0], last_b + 1])  # B ids before each group
    until_a = np.concatenate([last_a + 1, [piece.n_a]])  # A ids before each group's B ids
    place_a = np.arange(piece.n_a) + before_b[group_a]
    place_b = np.arange(piece.n_b) + until_a[group_b]
    forms = np.zeros(piece.n_a + piece.n_b, "i8")
    forms[place_a] = piece.a[: piece.n_a] + np.where(merged.tied_a, vocab.n_a, 0)
    forms[place_b] = 2 * vocab.n_a + piece.b[: piece.n_b].astype("i8") + np.where(merged.tied_b, vocab.n_b, 0)
    return forms, np.append(place_a, piece.n_a + piece.n_b)


def sides(piece: Piece, merged: Merged, vocab: Vocabularies) -> tuple[str, str, str, str, str]:
    """Ids up to the first shared end (A, B), text of the groups between the first and the last one, ids behind it (A, B)."""
    last_a, last_b = np.flatnonzero(merged.tied_a), np.flatnonzero(merged.tied_b)
    text = lambda ids: ",".join(map(str, ids.tolist()))
    a, b = piece.a[: piece.n_a], piece.b[: piece.n_b]
    if not len(last_a):
        return text(a), text(b), "", "", ""
    forms, _ = written_groups(piece, merged, vocab)
    body = forms[last_a[0] + last_b[0] + 2 : last_a[-1] + last_b[-1] + 2]
    return (
        text(a[: last_a[0] + 1]), text(b[: last_b[0] + 1]), "".join(map(vocab.forms.__getitem__, body.tolist())),
        text(a[last_a[-1] + 1 :]), text(b[last_b[-1] + 1 :]),
    )


def _tokens(paths: tuple[str, str], steps: int, block_steps: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Both tokenizers' ids of every document, cut into pieces; a task's documents fill its blocks one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task = worker_vocabularies(*paths), TaskContext.get().partitionId()
        block = row = filled = 0
        for batch in slices(batches):
            out: list[tuple] = []
            taken: list[int] = []
            for place, (a, b) in enumerate(vocab.tokens(batch.column("text").to_pylist())):
                pieces = cut(a, b, vocab, steps)
                for number, p in enumerate(pieces):
                    out.append(((task << 32) + block, (task << 33) + row, number, len(pieces), p.n_a, p.n_b, p.a_at, p.b_at, p.a.tobytes(), p.b.tobytes()))
                    taken.append(place)
                row, filled = row + 1, filled + len(a) + len(b)
                if filled >= block_steps:
                    block, filled = block + 1, 0
            kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()] * 2
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*columns[:2], batch.column("doc_id").take(pa.array(taken, pa.int64())), *columns[2:]], names)

    return run


def _bunches(batches: Iterator[pa.RecordBatch], vocab: Vocabularies, steps: int) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Rows of one block that are merged at once: documents of one piece each, one behind the other, or a single piece of a longer one.

    As both sides of a document end at the same byte, whole documents behind one another are merged like one.
    """
    for batch in slices(batches):
        blocks, pieces, n_a, n_b, a_at, b_at = (batch.column(c).to_numpy() for c in ("block", "pieces", "n_a", "n_b", "a_at", "b_at"))
        begin = 0
        while begin < batch.num_rows:
            end, size = begin + 1, n_a[begin] + n_b[begin]
            while pieces[begin] == 1 and end < batch.num_rows and pieces[end] == 1 and blocks[end] == blocks[begin] and size < steps:
                size += n_a[end] + n_b[end]
                end += 1
            rows = batch.slice(begin, end - begin)
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in (("a", vocab.kind_a), ("b", vocab.kind_b)))
            yield rows, Piece(a, b, int(n_a[begin:end].sum()), int(n_b[begin:end].sum()), int(a_at[begin]), int(b_at[begin]))
            begin = end


def _pairs(paths: tuple[str, str], steps: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each block's distinct linked pairs and in how many documents of one piece they are; pairs of other documents with the document's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = worker_vocabularies(*paths)
        span = vocab.n_a * vocab.n_b
        block, held, size = None, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            counts = np.zeros(len(codes), "i8")
            np.add.at(counts, at, np.concatenate([n for _, n in held]))
            return codes, counts

        def put() -> pa.RecordBatch:
            codes, counts = summed()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(counts), pa.nulls(len(codes), pa.int64())], names)

        for rows, piece in _bunches(batches, vocab, steps):
            here = rows.column("block")[0].as_py()
            if held and here != block:
                yield put()
                held, size = [], 0
            block, merged = here, merge(piece, vocab)
            if rows.column("pieces")[0].as_py() > 1:
                codes = np.unique(np.concatenate([merged.links_a, merged.links_b]))
                key = rows.column("key")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.nulls(len(codes), pa.int64()), pa.array(np.full(len(codes), key))], names)
                continue
            of_a, of_b = (np.repeat(np.arange(rows.num_rows), rows.column(c).to_numpy()) for c in ("n_a", "n_b"))
            in_documents = np.concatenate([of_a * span + merged.links_a, of_b[~merged.tied_b] * span + merged.links_b])
            codes, counts = np.unique(np.unique(in_documents) % span, return_counts=True)
            if not len(codes):
                continue
            held.append((codes, counts))
            size += len(codes)
            if size > HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return run


def _write_counts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows arrive block by block; writes each block's pairs, their counts and whether they are best as three arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> pa.RecordBatch:
            codes, counts, best = (np.concatenate(c) for c in zip(*held))
            codes, first = np.unique(codes, return_index=True)
            write_file(f"{path}/{block}.pairs", codes.astype("<i8").tobytes() + counts[first].astype("<i8").tobytes() + best[first].astype("u1").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(codes)], pa.int64())], ["block", "pairs"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "total", "best")]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if held and blocks[x] != block:
                    yield close()
                    held = []
                block = int(blocks[x])
                held.append(tuple(c[x:y] for c in columns))
        if held:
            yield close()

    return run


def read_counts(path: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's pairs in order, their counts and whether they are their A id's best."""
    raw = read_file(f"{path}/{block}.pairs")
    n = len(raw) // 17
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "u1", n, 16 * n)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the values, exact for integers."""
    until = np.concatenate([[0], np.cumsum(values, dtype="i8")])
    ends = np.cumsum(lengths)
    return until[ends] - until[ends - lengths]


def _scored(paths: tuple[str, str], counts_path: str, steps: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and groups of every piece, with the pairs' counts over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, block, known = worker_vocabularies(*paths), None, None
        for rows, piece in _bunches(batches, vocab, steps):
            merged = merge(piece, vocab)
            n_a, n_b = rows.column("n_a").to_numpy(), rows.column("n_b").to_numpy()
            single = rows.column("pieces")[0].as_py() == 1
            totals = np.zeros((2, rows.num_rows), "i8")
            open_b = _sums(~merged.tied_b, n_b)
            if len(merged.links_a) or len(merged.links_b):
                here = rows.column("block")[0].as_py()
                if here != block:
                    block, known = here, read_counts(counts_path, here)
                for links, lengths in ((merged.links_a, n_a), (merged.links_b, open_b)):
                    at = np.searchsorted(known[0], links)
                    totals += [_sums(known[2][at], lengths), _sums(known[1][at], lengths)]
            numbers = [n_a, n_b, _sums(merged.tied_a, n_a), n_a + open_b, *totals]
            if single:
                forms, places = written_groups(piece, merged, vocab)
                written = list(map(vocab.forms.__getitem__, forms.tolist()))
                ends = np.cumsum(n_a + n_b).tolist()
                text = ["".join(written[x:y])[:-1] for x, y in zip([0, *ends], ends)]
                texts = [[hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]] + [[None] * len(text)] * 5
            else:
                texts = [[None], *[[s] for s in sides(piece, merged, vocab)]]
            head = [rows.column(c) for c in ("key", "doc_id", "piece")]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array(c, pa.int64()) for c in numbers], *[pa.array(c, pa.string()) for c in texts]], names)

    return run


def _stitched(pieces: pa.Table) -> pa.Table:
    """The pieces of one document, in order: what is open behind one goes before the next one's first group."""
    pieces = pieces.sort_by("piece")
    digest, before = hashlib.sha256(), ""
    open_a: list[str] = []
    open_b: list[str] = []
    for row in range(pieces.num_rows):
        n_groups, head_a, head_b, body, tail_a, tail_b = (pieces.column(c)[row].as_py() for c in ("n_groups", "head_a", "head_b", "body", "tail_a", "tail_b"))
        open_a += [head_a] if head_a else []
        open_b += [head_b] if head_b else []
        if n_groups:
            text = f"{before}{','.join(open_a)}|{','.join(open_b)}" + (f";{body[:-1]}" if body else "")
            digest.update(text.encode())
            before, open_a, open_b = ";", [tail_a] if tail_a else [], [tail_b] if tail_b else []
    sums = [pa.array([sum(pieces.column(c).to_pylist())], pa.int64()) for c in COUNTS]
    return pa.table([pieces.column("doc_id").slice(0, 1), *sums, pa.array([digest.hexdigest()])], ["doc_id", *COUNTS, "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, steps: int = STEPS, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text. Null and empty texts, and such whose tokens do not give their bytes back,
    have no tokens: zeros, and an empty digest. Repeated rows, also of one id, are documents of their own. A pair's count
    is the number of rows with it linked; ties for an A id's highest count are all best. Other columns are ignored.

    Tokens are written once, as blocks of consecutive documents. Counts meet by pair, which spreads them evenly; an A id's
    highest count is a row per entry of A's vocabulary and is broadcast. Only pieces of documents of more than
    ``steps`` ends meet again, one document to a group.
    """
    spark, paths = docs.sparkSession, (path_a, path_b)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces_schema, scored_schema = PIECES.format(kind=kind), SCORED.format(kind=kind)
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    rows = docs.select("doc_id", whole_text().alias("text"))
    tokens = materialised(rows.mapInArrow(_tokens(paths, steps, block_steps, names(pieces_schema)), pieces_schema), "tokens")
    pairs = materialised(tokens.mapInArrow(_pairs(paths, steps, names(PAIRS)), PAIRS), "pairs")

    each = pairs.where(F.col("key").isNotNull()).select("code", "key").distinct().select("code", F.lit(1).cast("long").alias("n"))
    totals = pairs.where(F.col("key").isNull()).select("code", "n").unionByName(each).groupBy("code").agg(F.sum("n").alias("total"))
    vocab = worker_vocabularies(*paths)
    totals = materialised(totals.withColumn("a", F.expr(f"code div {vocab.n_b}")), "totals")
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))
    judged = totals.join(F.broadcast(highest), "a").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))
    counts_path = fresh_path(spark, "pair-counts")
    placed = pairs.select("block", "code").join(judged, "code").repartition("block").sortWithinPartitions("block")
    placed.select("block", "code", "total", "best").mapInArrow(_write_counts(counts_path), "block long, pairs long").write.parquet(f"{counts_path}/written.parquet")

    score = _scored(paths, counts_path, steps, names(scored_schema))
    columns = ["doc_id", *COUNTS, "groups_sha256"]
    single = tokens.where(F.col("pieces") == 1).mapInArrow(score, scored_schema).select(*columns)
    several = tokens.where(F.col("pieces") > 1).mapInArrow(score, scored_schema).groupBy("key").applyInArrow(
        _stitched, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
    )
    return single.unionByName(several)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_token_alignment": op12_token_alignment}
