"""Offset-preserving encoding against the library's own ids, texts and offsets, also under other normalisations."""

import hashlib
import random

import numpy as np
import pytest

from fieldtrust.llm.common import tokenizer_path
from fieldtrust.llm.pieces import PieceEncoder, _fields, _message, digests, encode

PARTS = (
    "ab", "the", " the", "▁", "▁▁", " ", "  ", "\n", "\n\n", "\t", "é", "é", "中文", "😀", "\0", "<s>", "<0x0A>", "<unk>", "x" * 70,
    "�", "①", "㌢", "ﾊﾟ", "Å", "　", "\xa0", "ﬁ", "​", "Straße",
)


def texts(count, seed):
    rng = random.Random(seed)
    yield ""
    for _ in range(count):
        some = rng.sample(PARTS, rng.randint(1, 8))
        yield "".join(rng.choice(some) for _ in range(rng.choice((1, 2, 3, 20, 60))))


def model(rule="identity", prefix=1, squeeze=0, suffix=0):
    """The public model with another normalisation."""
    from sentencepiece import SentencePieceNormalizer

    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        fields = list(_fields(file.read()))
    chars = dict(_fields(SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    spec = _message((1, rule.encode()), (2, chars[2]), (3, prefix), (4, squeeze), (5, 1))
    floats = (10, 15, 51)
    trainer = lambda raw: _message(*[(n, v) for n, v in _fields(raw) if n not in (*floats, 24)], (24, suffix))
    return _message(*[(n, spec if n == 3 else trainer(v) if n == 2 else v) for n, v in fields])


def assert_equal_to_library(encoder, text):
    want = encoder.library.encode(text, return_type="proto").pieces
    ids, edges = encoder.encode(text)
    assert ids.tolist() == [p.id for p in want], text
    assert list(zip(edges[:-1].tolist(), edges[1:].tolist())) == [(p.begin, p.end) for p in want], text
    assert encoder.decode(ids) == encoder.library.decode([p.id for p in want]), text


def test_ids_offsets_and_texts_equal_the_library():
    encoder = PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    for text in texts(1500, 1):
        assert_equal_to_library(encoder, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix,squeeze,suffix", [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)])
def test_other_character_maps(rule, prefix, squeeze, suffix):
    encoder = PieceEncoder.of(model(rule, prefix, squeeze, suffix))
    for text in texts(200, prefix + 2 * squeeze + 4 * suffix):
        assert_equal_to_library(encoder, text)


def test_parts_equal_the_whole():
    encoder = PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    for text in [*texts(200, 5), "unsplit" * 400, "long text, " * 300]:
        normal, _ = encoder.normalised(text)
        for part in (1, 7, 64):
            assert encoder.ids_of(normal, part).tolist() == encoder.library.encode(text)


def test_decoding_any_ids():
    encoder, rng = PieceEncoder(tokenizer_path("piece_bpe_32k.model")), random.Random(3)
    for _ in range(500):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(260), 29871)) for _ in range(rng.randrange(12))]
        assert encoder.decode(np.array(ids, "<u4")) == encoder.library.decode(ids)


def test_other_models_are_refused():
    plain = _message((1, _message((1, b"a"))), (2, _message((3, 1))))
    with pytest.raises(ValueError, match="byte fallback"):
        PieceEncoder.of(plain)


def test_rows(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [*enumerate(texts(40, 9)), (50, "twice"), (50, "twice"), (51, None), (None, "no id")]
    docs = spark.createDataFrame([(i, t, b"clash", "c") for i, t in rows], "doc_id long, text string, ids binary, decoded string")
    library = PieceEncoder(path).library
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        pieces = library.encode(t or "", return_type="proto").pieces
        edges = [p.begin for p in pieces] + [len((t or "").encode())]
        ids = [p.id for p in pieces]
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()), sha(np.array(edges, "<u4").tobytes())))
    got = digests(encode(docs, path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "edges_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert digests(encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("piece_bpe_32k.model"))).count() == 0
