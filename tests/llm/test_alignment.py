"""Merge-path alignment against every pair of tokens of every document."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldtrust.llm.alignment import Vocabularies, align, cut, split
from fieldtrust.llm.common import tokenizer_path

PARTS = ("the", " the", "token", "ization", " ", "  ", "\n", "é", "é", "中文", "😀", "1234", "'s", "<|endoftext|>", "<s>", "x" * 9, "...", "\t", "\0")


def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def texts(count, seed, parts=PARTS, sizes=(1, 4, 30)):
    rng = random.Random(seed)
    for _ in range(count):
        some = rng.sample(parts, min(len(parts), rng.randint(1, 8)))
        yield "".join(rng.choice(some) for _ in range(rng.choice(sizes)))


def brute(rows):
    """The columns of ``align`` by comparing all token pairs, from the libraries themselves."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = paths()
    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    hidden = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x < 256)]
    byte = {chr(256 + i): x for i, x in enumerate(hidden)} | {chr(x): x for x in range(256) if x not in hidden}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    documents = []
    for doc_id, text in rows:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        parts_a, parts_b = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == f" {text}".encode():
            documents.append((doc_id, [], [], [], []))
            continue

        def spans(parts):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            return list(zip([0, *ends], ends))

        spans_a, spans_b = spans(parts_a), spans(parts_b)
        links = [(i, j) for (s, e), i in zip(spans_a, ids_a) for (s2, e2), j in zip(spans_b, ids_b) if s < e2 and s2 < e]
        groups, edges = [], [0, *sorted({e for _, e in spans_a} & {e for _, e in spans_b})]
        for low, high in zip(edges, edges[1:]):
            inside = lambda spans_, ids: ",".join(str(i) for (s, e), i in zip(spans_, ids) if low <= s and e <= high)  # noqa: E731, B023
            groups.append(f"{inside(spans_a, ids_a)}|{inside(spans_b, ids_b)}")
        documents.append((doc_id, ids_a, ids_b, links, groups))
    counts = Counter(p for d in documents for p in set(d[3]))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [
        (
            doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, ids_a, ids_b, links, groups in documents
    ]


@pytest.mark.parametrize("steps,block_steps", [(1 << 18, 1 << 24), (16, 200), (1, 50)])
def test_equal_to_all_token_pairs(spark, steps, block_steps):
    rows = [*enumerate(texts(120, 4)), (500, None), (501, ""), (502, "a ▁ b"), (502, "▁"), (503, "twice the same"), (503, "twice the same"), (None, "no id"), (504, " "), (505, "ab" * 300)]
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_a int, key string").repartition(3)
    got = align(docs, *paths(), steps=steps, block_steps=block_steps).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)
    assert sum(r["n_a"] == 0 for r in got) == 4


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *paths()).count() == 0


def test_pieces_are_of_equal_work():
    vocab, rng = Vocabularies(*paths()), random.Random(5)
    text = " ".join(rng.choice(PARTS) for _ in range(3000))
    ((a, b),) = vocab.tokens([text])
    for steps in (7, 100, 1000):
        pieces = cut(a, b, vocab, steps)
        assert sum(p.n_a for p in pieces) == len(a) and sum(p.n_b for p in pieces) == len(b)
        assert all(abs(p.n_a + p.n_b - steps) <= 1 for p in pieces[:-1])


def test_split_equals_a_stable_merge():
    rng = random.Random(6)
    for _ in range(300):
        ends_a, ends_b = (np.array(sorted(rng.sample(range(1, 30), rng.randint(0, 12)))) for _ in range(2))
        merged = sorted([(e, 0) for e in ends_a] + [(e, 1) for e in ends_b])
        for d in range(len(merged) + 1):
            first = [side for _, side in merged[:d]]
            tie = 0 < d < len(merged) and merged[d - 1][0] == merged[d][0]
            assert split(ends_a, ends_b, d) == (first.count(0), first.count(1) + tie)
