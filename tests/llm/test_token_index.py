"""The store read back against plain encoding, and the hash against a dictionary."""

import json
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtrust.llm import byte_chunks, token_index
from fieldtrust.llm.bpe import TreeEncoder
from fieldtrust.llm.common import slices_by_bytes, tokenizer_path
from fieldtrust.llm.token_index import IndexPart, PerfectHash, every_key, look_up, read_documents, write_store

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 2), dtype="u8")
    hashing = PerfectHash.build(keys)
    assert sorted(hashing.slots(keys).tolist()) == list(range(n))
    # With one level most keys go to the list; slots stay minimal.
    assert sorted(PerfectHash.build(keys, most=1).slots(keys).tolist()) == list(range(n))


def test_index_part_round_trip():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, (5000, 2), dtype="u8")
    keys[:2000] = np.repeat(keys[:1000], 2, axis=0)  # keys that share a half
    keys[1:2000:2, 1] += np.uint64(1)
    keys[2000:2500, 1] = 7
    values = [rng.integers(0, 2**40, 5000) for _ in range(3)]
    part = IndexPart.load(IndexPart.build(keys, *values).dump())
    found, places = part.find(keys)
    assert found.all()
    assert all((places[c] == v).all() for c, v in zip(("shard", "offset", "length"), values))
    strangers = rng.integers(0, 2**64, (20_000, 2), dtype="u8")
    assert part.find(strangers)[0].sum() < 5  # 32-bit fingerprints


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([[1, 2], [1, 2]], "u8"))


@pytest.mark.parametrize("plain", [False, True])
def test_chunk_table_equals_the_library(plain, monkeypatch):
    monkeypatch.setattr(byte_chunks, "TABLE", 50)
    encoder, rng = byte_chunks.ByteEncoder(VOCABULARY, plain), random.Random(8)
    parts = ["ab", "the", " the", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "é", "中文", "😀", "\0", "<|endoftext|>", "<|endof", "text|>", "'s", "1", "x" * 70, "\xa0", "ä"]
    for _ in range(60):
        some = rng.sample(parts, rng.randint(1, 8))
        texts = ["".join(rng.choice(some) for _ in range(rng.choice((0, 1, 2, 3, 20, 60)))) for _ in range(30)]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(i, encoder.kind).tolist() for i in encoder.ids(texts)] == want


def library(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def numbers(encoder, texts):
    return [np.frombuffer(i, encoder.kind).tolist() for i in encoder.ids(texts)]


def test_words_with_punctuation_are_put_together():
    encoder = byte_chunks.ByteEncoder(VOCABULARY)
    texts = ["a qzwort über", "a qzwort, qzwort. über!!! qzwort.\nZeile. (qzwort"]
    asked = []
    plain = encoder._words
    encoder._words = lambda words: asked.extend(words) or plain(words)
    assert [numbers(encoder, [t])[0] for t in texts] == library(encoder, texts)
    # Known words are not encoded again for what stands behind them.
    assert sorted(asked) == sorted([" qzwort", " über", "\nZeile", " (qzwort"])


@pytest.mark.parametrize("plain", [False, True])
def test_parts_equal_the_library(plain, monkeypatch):
    monkeypatch.setattr(byte_chunks, "TABLE", 100)
    encoder, rng = byte_chunks.ByteEncoder(VOCABULARY, plain), random.Random(4)
    parts = [" the", " Über", "école", " ", " ", "\n", "\nDie", ".", ",", "***", "(", "'", "'s", "_", "-", "7", "<|endoftext|>", "\t", "ɏ", "ɐ", "×", "ß", "z" * 70]
    for _ in range(60):
        some = rng.sample(parts, rng.randint(1, 8))
        texts = ["".join(rng.choice(some) for _ in range(rng.choice((0, 1, 3, 20, 60)))) for _ in range(30)]
        want = library(encoder, texts)
        assert numbers(encoder, texts) == want
        assert numbers(encoder, pa.array(["x", *texts]).slice(1)) == want
        assert [np.frombuffer(b"".join(ids), encoder.kind).tolist() for _, ids in encoder.chunks(texts)] == want


def test_other_ways_to_cut_words(tmp_path):
    settings = json.loads(Path(VOCABULARY).read_text())
    cut = {"type": "Split", "pattern": {"Regex": r" ?[^\s\p{L}]+[\r\n]*| ?\p{L}+|\s+"}, "behavior": "Isolated", "invert": False}
    settings["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [cut, settings["pre_tokenizer"] | {"use_regex": False}]}
    (tmp_path / "other.json").write_text(json.dumps(settings))
    encoder = byte_chunks.ByteEncoder(str(tmp_path / "other.json"))
    texts = ["one two three", "one two,\nthree two.\ntwo", "two..\nOne"]
    assert [numbers(encoder, [t])[0] for t in texts] == library(encoder, texts)
    assert not encoder.in_parts


def test_slices_by_bytes():
    texts = ["a" * n for n in (3, 0, 0, 9, 30, 1, 1, 1)] + [None]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], ["text", "n"])
    found = [s.column("n").to_pylist() for s in slices_by_bytes(iter([rows, rows.slice(0, 0), rows.slice(4)]), "text", 10)]
    assert [n for s in found for n in s] == [*range(9), *range(4, 9)]
    sizes = [[len(texts[n] or "") for n in s] for s in found]
    assert all(sum(s) - max(s) < 10 for s in sizes) and len(sizes) == 4


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        byte_chunks.ByteEncoder(tokenizer_path("word_bpe_49k.json"))


def expected(docs):
    tokenizer = TreeEncoder(VOCABULARY).tokenizer
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(spark, docs, path, **sizes):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS + ", start int, ids string").repartition(5)
    parts = write_store(frame, path, VOCABULARY, **sizes)
    rows = read_documents(every_key(frame), path, parts).select("doc_id", "start", "length", F.crc32("ids"))
    return sorted(map(tuple, rows.collect()), key=repr)


def test_store_equals_plain_encoding(spark, tmp_path):
    rng = random.Random(3)
    docs = [(7 * i, " ".join(rng.choice(["the", "thing", "中文", "😀", "<|endoftext|>", "\n"]) for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(120)]
    docs += [(1, None), (2, ""), (None, "no id")]
    rng.shuffle(docs)
    assert read_back(spark, docs, str(tmp_path / "s"), shard_bytes=500, part_keys=10) == sorted(expected(docs), key=repr)


def test_repeated_ids(spark, tmp_path):
    docs = [(5, "same")] * 3 + [(5, "other"), (4, "x"), (6, "y"), (None, None), (None, None)]
    rows = read_back(spark, docs, str(tmp_path / "s"))
    want = expected(docs)
    assert sorted((r[0] or -1, r[2], r[3]) for r in rows) == sorted((r[0] or -1, r[2], r[3]) for r in want)
    ends = sorted((r[1], r[1] + r[2]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_unknown_keys_are_not_found(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a") for i in range(50)], DOCS)
    parts = write_store(frame, str(tmp_path / "s"), VOCABULARY)
    assert look_up(spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal")), str(tmp_path / "s"), parts).count() == 0


def test_empty_table(spark, tmp_path):
    assert read_back(spark, [], str(tmp_path / "s")) == []


def test_wrong_files_are_refused():
    with pytest.raises(ValueError):
        IndexPart.load(b"\0" * 64)
    assert token_index.shard_name("/x", (3 << 32) + 2) == "/x/shards/000003-000002.ids"
