"""What kind of file some bytes are, and how many pages a PDF has, by signature and page objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of the formats, in hexadecimal, and the suffixes that name them.
SIGNATURES = {
    "pdf": ["255044462D"],
    "png": ["89504E470D0A1A0A"],
    "jpeg": ["FFD8FF"],
    "tiff": ["49492A00", "4D4D002A"],
    "bmp": ["424D"],
}
RIFF, WEBP = "52494646", "57454250"
SUFFIX_KINDS = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".tiff": "tiff", ".tif": "tiff", ".bmp": "bmp", ".webp": "webp"}

#: Bytes at the end of a PDF in which its end mark has to stand.
TAIL = 1024


def file_kind(content: Column) -> Column:
    """Name of the format whose signature the bytes begin with; NULL without one."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(F.startswith(head, F.lit(RIFF)) & F.endswith(head, F.lit(WEBP)), "webp")
    for name, signatures in SIGNATURES.items():
        for signature in signatures:
            kind = kind.when(F.startswith(head, F.lit(signature)), name)
    return kind


def kind_of_suffix(suffix: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_KINDS.items() for x in pair]), suffix)


def _latin(content: Column) -> Column:
    """One character per byte."""
    return F.decode(content, "ISO-8859-1")


def pdf_pages(content: Column) -> Column:
    """Page objects of a PDF; such inside compressed object streams are not seen, where the page tree's count stands in for them."""
    text = _latin(content)
    objects = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"/Type\s*/Pages\b[^>]*?/Count\s+(\d{1,9})"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(objects > 0, objects).otherwise(F.coalesce(F.array_max(counts), F.lit(0)))


def pdf_is_whole(content: Column) -> Column:
    """Whether the end mark stands near the end."""
    return F.contains(_latin(F.substring(content, -TAIL, TAIL)), F.lit("%%EOF")) | (
        (F.octet_length(content) < TAIL) & F.contains(_latin(content), F.lit("%%EOF"))
    )
