import datetime as dt

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.functions import paths as P, text as X, values as V

from .names import names, pieces, route, tokens

AS_OF = dt.date(2024, 6, 1)


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_derive_name(spark):
    paths = ["/a/b.txt", "/a/b/", "/a//", "/", "", "x", "/a/new\nline"]
    assert column(spark, paths, P.derive_name) == ["b.txt", "b", "a", "", "", "x", "new\nline"]


def test_parent_and_root(spark):
    paths = ["/a/b/c", "/a/b/", "/a", "/"]
    assert column(spark, paths, P.parent) == ["/a/b", "/a", "/", None]
    assert column(spark, paths, P.root_of) == ["/a", "/a", "/a", ""]


def test_derive_class(spark):
    rows = [
        ("a.txt", False, "txt"), ("conf.d", True, "d"), (".bashrc", False, "bashrc"), ("name.", False, "file"),
        ("Makefile", False, "file"), ("src", True, "folder"), ("Makefile", None, "unknown"), ("a.TXT", None, "TXT"),
        ("a.tar.gz", False, "gz"),
    ]
    frame = spark.createDataFrame(rows, "name string, is_dir boolean, want string")
    assert frame.where(P.derive_class("name", "is_dir") != F.col("want")).count() == 0


def test_mtime_date_ignores_session_zone(spark):
    seconds = [0, 86399, 86400, -1, None, 1704067199]
    want = [dt.date(1970, 1, 1), dt.date(1970, 1, 1), dt.date(1970, 1, 2), AS_OF, AS_OF, dt.date(2023, 12, 31)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert column(spark, seconds, lambda c: P.mtime_date(F.timestamp_seconds(c), AS_OF), "bigint") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_format_size(spark):
    sizes = [0.0, 1023.0, 1024.0, 1280.0, 1331.2, float(2**20), 1.5 * 2**20, float(2**30), 2.25 * 2**40]
    assert column(spark, sizes, V.format_size, "double") == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.3 KB", "1.0 MB", "1.5 MB", "1.0 GB", "2304.0 GB",
    ]


def test_small_values(spark):
    assert column(spark, [100.0, 0.0, 33.333, 0.125, 99.999], V.format_percent, "double") == [
        "100", "0.00", "33.33", "0.12", "100.00",
    ]
    assert column(spark, ["true", "false", "True", "1", None], V.parse_bool) == [True, False, None, None, None]
    assert column(spark, ["  a b\t\n", "　x　", "   "], V.normalize_query) == ["a b", "x", ""]
    assert column(spark, ['["/a","/b"]', "[]", "broken"], V.parse_prefix_list) == [["/a", "/b"], [], None]
    assert column(spark, [0.0, None], P.size_double, "double") == [0.0, 0.0]


def test_decode_path(spark):
    raw = [b"/ok", b"/bad\xff"]
    assert column(spark, raw, lambda c: V.decode_path(c, strict=False), "binary") == ["/ok", "Invalid UTF-8"]
    with pytest.raises(PySparkException):
        column(spark, raw, V.decode_path, "binary")


def test_words(spark):
    texts = [*names(1, 150), "", "--", "Ünïted²"]
    assert column(spark, texts, X.tokenize_words) == [re.findall(r"[^\W_]+", t) for t in texts]


def test_language_and_han(spark):
    texts = [*names(2, 150), "タ漢字", "한漢字漢", ""]
    assert column(spark, texts[:150], X.route_language) == [route(t) for t in texts[:150]]
    assert column(spark, texts[150:], X.route_language) == ["other"] * 3
    assert column(spark, texts[:150], X.segment_han) == [[t for run in re.findall(r"[^\W_]+", n) for t in pieces(run)] for n in texts[:150]]
    assert column(spark, texts[:150], X.tokenize_mixed) == [tokens(t) for t in texts[:150]]


def test_registry(spark):
    X.register_tokenizer("lower", lambda c: X.tokenize_words(F.lower(c)))
    assert column(spark, ["A b"], lambda c: X.tokenize(c, "lower")) == [["a", "b"]]
    with pytest.raises(KeyError):
        X.tokenizer("absent")
    with pytest.raises(TypeError):
        X.register_tokenizer("bad", None)
