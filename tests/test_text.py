"""Scalar rules on hand-made values."""

import pytest
from pyspark.sql import functions as F

from poolwright.functions import files, text


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given, n, want",
    [("abc", 3, "abc"), ("  abcd ", 3, "abc"), ("aé", 2, "a"), ("é", 1, ""), ("日本", 4, "日"), ("😀x", 3, ""), ("a�", 4, "a�"), (None, 5, "")],
)
def test_clip(spark, given, n, want):
    got = spark.createDataFrame([(given,)], "t string").select(text.clip("t", n).alias("out")).first()["out"]
    assert got == want


def test_trim_is_unicode(spark):
    assert value(spark, text.trim_space("t"), t="　 a b  ") == "a b"


def test_coherent(spark):
    assert value(spark, text.coherent("t"), t="0123456789abcdef") is True
    assert value(spark, text.coherent("t"), t="0123456789abcde") is False
    assert value(spark, text.coherent("t"), t="\x01" * 4 + "0123456789abcdef") is False
    assert value(spark, text.coherent("t"), t="") is False


def test_squeeze(spark):
    assert value(spark, text.squeeze_blank_lines("t"), t="a \t\n \n\n\nb\n\nc\n") == "a\n\nb\n\nc"


def test_bom(spark):
    assert value(spark, text.strip_bom("t"), t="﻿﻿a") == "﻿a"


def test_query_terms(spark):
    got = value(spark, text.query_terms("t"), t="The café's LAMP, the 42nd lamp of 7")
    assert sorted(got) == ["42nd", "caf", "lamp", "the"]


def test_error_kind(spark):
    kinds = {"": "empty", " \n": "empty", "<p>": "proxy", "Error code 524": "proxy", "No engine": "message"}
    for body, kind in kinds.items():
        assert value(spark, text.error_kind("t"), t=body) == kind


def test_paths(spark):
    assert value(spark, text.display_path("t"), t=" ") == "document"
    assert value(spark, text.image_path("t", "p"), t="manual.pdf", p=2) == "manual.pdf (image on page 2).jpg"


HEADS = [
    ("layout.png", b"\x89PNG\r\n\x1a\n....", "image/png"),
    ("manual.pdf", b"%PDF-1.7 ...", "application/pdf"),
    ("notes.md", b"# Notes", "text/markdown"),
    ("wiring.txt", b"HDMI to TV", "text/plain; charset=utf-8"),
    ("DATA.CSV", b"a,b\n1,2", "text/csv"),
    ("config.json", b'{"a": 1}', "text/plain; charset=utf-8"),
    ("photo.webp", b"RIFF\x01\x02\x03\x04WEBPVP8 ", "image/webp"),
    ("odd.txt", b"\x01valid utf-8", "text/plain; charset=utf-8"),
    ("latin.txt", b"caf\xe9", "text/plain; charset=utf-8"),
    ("blob.bin", b"\x00\x01\x02\x00\xff\xfe\x00", ""),
    ("archive.zip", b"PK\x03\x04\x00", ""),
    ("cut.txt", b"\x01" + b"a" * 510 + "é".encode(), ""),
]


def test_upload_kinds(spark):
    df = spark.createDataFrame([(n, bytearray(h)) for n, h, _ in HEADS], "name string, data binary")
    got = {r.name: r.k for r in df.select("name", files.upload_kind("name", "data").alias("k")).collect()}
    for name, _, mime in HEADS:
        assert got[name].mime == mime, name
        assert (got[name].reason == "") == (mime != "")
    assert "application/zip" in got["archive.zip"].reason


def test_names(spark):
    names = {"../a/b.txt": "b.txt", "  x\x07y.md ": "xy.md", "": "file", "///": "file", "dir/": "dir", ".": "file", "é" * 100: "é" * 60}
    for given, want in names.items():
        assert value(spark, files.clean_name("n"), n=given) == want
    assert value(spark, files.with_ending("n", "m"), n="A.JPG", m="image/jpeg") == "A.JPG"
    assert value(spark, files.with_ending("n", "m"), n="a (image)", m="image/jpeg") == "a (image).jpg"
    assert value(spark, files.with_ending("n", "m"), n="a", m="text/plain") == "a"
