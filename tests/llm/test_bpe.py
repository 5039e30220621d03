"""Tree concatenation against the library's encoding of whole texts."""

import hashlib
import random

import numpy as np
import pytest

from fieldtrust.llm.bpe import TreeEncoder, digests, encode
from fieldtrust.llm.common import tokenizer_path

PARTS = (
    "ab", "the", "tion", "A", "é", "é", "ß", "İ", "Σ", "1", "23", "'", "'s", "'ll", "!", "...", "\n", "\n\n", " ", "  ", "\t",
    "\xa0", "\x85", "\x1c", "中文", "😀", "👨‍👩‍👧", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "<|startoftext|>", "a" * 40, "́",
)


def texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        some = rng.sample(PARTS, rng.randint(1, 9))
        yield "".join(rng.choice(some) for _ in range(rng.choice((1, 3, 20, 60, 300))))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("leaf", [1, 3, 17, 200])
def test_tree_equals_whole_text(name, leaf):
    encoder = TreeEncoder(tokenizer_path(name), leaf)
    for text in texts(400, leaf):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, text
        assert "".join(encoder.segments(text)[0]) == text


def test_long_unsplit_texts():
    encoder = TreeEncoder(tokenizer_path("byte_bpe_50k.json"), 64)
    rng = random.Random(1)
    for letters in ("ab", "etaoin", "x", "中文字"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_cut_over_tasks(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(texts(40, 9))]
    rows += [(50, "long text, " * 400), (50, "long text, " * 400), (51, "unsplit" * 500), (52, None), (53, ""), (None, "no id"), (54, "x" * 4000)]
    docs = spark.createDataFrame([(i, t, b"clash", "c") for i, t in rows], "doc_id long, text string, ids binary, decoded string")
    got = digests(encode(docs, path, piece=256)).collect()
    tokenizer = TreeEncoder(path).tokenizer
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).count() == 0
