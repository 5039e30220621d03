"""Archives read back, by the operator and frame by frame."""

import io
import random
import struct

import zstandard
import pytest

from fieldtrust.llm.files import place
from fieldtrust.llm.warc import DICTIONARY_FRAME, base32_sha1, read_archives, read_records, record, train, write_archives

PAGES = "page_id long, url string, html string"


def corpus():
    rng = random.Random(1)
    pages = [(i, f"http://x.org/{i}", "<html>" + " ".join(rng.choice(["a", "dé", "中"]) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    pages += [(1000 - i, f"http://hot.org/{i}", "<p>same page</p>") for i in range(60)]
    pages += [(2000, None, None), (2001, "http://e.org\r\nX: 1", ""), (2002, "", "a\r\n\r\nWARC/1.1\r\n"), (2003, "u", "é" * 90_000)]
    rng.shuffle(pages)
    return pages


def expected(pages, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, p in payloads:
        first[p] = min(i, first.get(p, i))
    return sorted(
        (i, len(p), base32_sha1(p), "response", None) if len(p) < least or first[p] == i else (i, len(p), base32_sha1(p), "revisit", first[p])
        for i, p in payloads
    )


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, tmp_path, least):
    pages = corpus()
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], PAGES + ", record_type string, refers_to int").repartition(4)
    path = str(tmp_path / "w")
    files = write_archives(frame, path, min_bytes=least, file_bytes=4000)
    assert sum(r["records"] for r in files.collect()) == len(pages)
    assert files.count() > 4
    assert sorted(map(tuple, read_archives(files, path).collect()), key=lambda r: r[0]) == expected(pages, least)


def test_records_are_frames_behind_the_dictionary(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = corpus()
    file = write_archives(spark.createDataFrame(pages, PAGES).coalesce(1), path).first()["file"]
    system, name = place(f"{path}/{file}")
    raw = system.open_input_file(name).read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == DICTIONARY_FRAME
    words, rest, frames = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), raw[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == len(pages)


def test_the_dictionary_helps():
    samples = [record(i, f"http://example.org/{i}", f"<html><body><h1>Title {i}</h1></body></html>".encode()) for i in range(400)]
    words = zstandard.ZstdCompressionDict(train(samples, 4096))
    plain = sum(len(zstandard.ZstdCompressor().compress(s)) for s in samples)
    assert sum(len(zstandard.ZstdCompressor(dict_data=words).compress(s)) for s in samples) < plain / 2


def test_long_records_train_the_dictionary(spark, tmp_path):
    """Pages all longer than a sample may be."""
    line = "<li class='entry'><a href='/catalogue/item/{}'>Item number {} of the catalogue</a></li>"
    pages = [(i, f"http://e.org/{i}", "".join(line.format(i * 1000 + j, j) for j in range(400))) for i in range(60)]
    path = str(tmp_path / "long")
    files = write_archives(spark.createDataFrame(pages, PAGES), path)
    raw = (tmp_path / "long" / files.first()["file"]).read_bytes()
    words = raw[8 : 8 + struct.unpack_from("<II", raw)[1]]
    assert len(words) > 1000 and b"catalogue" in words
    assert read_archives(files, path).count() == 60


def test_edges(spark, tmp_path):
    empty = str(tmp_path / "none")
    assert read_archives(write_archives(spark.createDataFrame([], PAGES), empty), empty).count() == 0
    odd = [(None, None, None), (None, "u", "x"), (3, "v", "x"), (3, "v", "x"), (4, None, "x")]
    path = str(tmp_path / "odd")
    rows = sorted(
        ((r["page_id"], r["record_type"], r["refers_to"]) for r in read_archives(write_archives(spark.createDataFrame(odd, PAGES), path), path).collect()), key=repr
    )
    assert rows == sorted([(None, "response", None), (None, "revisit", 3), (3, "response", None), (3, "response", None), (4, "revisit", 3)], key=repr)


def test_damage_is_noticed():
    frame = struct.pack("<II", DICTIONARY_FRAME, 8) + b"\r" * 8
    cut = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"\r" * 8)).compress(record(1, "u", b"abc")[:-6])
    with pytest.raises(ValueError):
        list(read_records(frame + cut))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(b"\0" * 40).getvalue()))
