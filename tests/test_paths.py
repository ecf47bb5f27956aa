import pytest
from pyspark.sql import functions as F

from shelfmark.errors import NoMatch, Usage
from shelfmark.functions import paths as P
from shelfmark.functions.sizes import parse_size, parse_spec
from shelfmark.operators import catalog as O


def value(spark, column, path):
    return spark.createDataFrame([(path,)], "p string").select(column(F.col("p"))).first()[0]


@pytest.mark.parametrize("pattern, path, want", [
    ("", "a/b", True), (".", "a", True), ("a", "a", True), ("a", "a/b", True), ("a/", "a/b", True), ("a", "ab", False), ("*.txt", "d/e.txt", True), ("d/*.txt", "d/e.txt", True),
    ("d/*", "d/e/f", False), ("d/?", "d/e", True), ("[a-c]x", "bx", True), ("[^a]x", "bx", True), ("[^a]x", "ax", False), ("[", "[", True), ("[", "x", False), ("a[1].txt", "a[1].txt", True), ("\\*", "*", True), ("\\*", "x", False), ("x[", "y/x[", False),
])
def test_matches(spark, pattern, path, want):
    assert value(spark, lambda p: P.matches(p, pattern), path) is want


def test_regex_is_whole_and_linear(spark):
    assert value(spark, lambda p: P.regex_matches(p, "a.*"), "a\nb") is True
    assert value(spark, lambda p: P.regex_matches(p, "a"), "a\n") is False
    assert value(spark, lambda p: P.regex_matches_or_parent(p, ["d/e"]), "d/e/f") is True
    for bad in ("a)|(b", "(a)\\1", "(?=a)"):
        with pytest.raises(Usage):
            P.check_expression(bad)


@pytest.mark.parametrize("path, want", [("/a//b/./c", "a/b/c"), ("../a", "a"), ("a/../b", "b"), ("a/../../b", "b"), ("", "."), ("/", "."), ("a/b/..", "a")])
def test_store_path(spark, path, want):
    assert value(spark, P.store_path, path) == want


@pytest.mark.parametrize("path, n, want", [("a/b/c", 1, "b/c"), ("a/b/c", 2, "c"), ("a/b/c", 3, None), ("a", 0, "a")])
def test_strip(spark, path, n, want):
    assert value(spark, lambda p: P.strip(p, n), path) == want


def test_every_pattern_must_match(spark):
    rows = spark.createDataFrame([("a/b",), ("c",)], "path string")
    assert O.select(rows, ["a"]).count() == 1
    with pytest.raises(NoMatch, match="zz"):
        O.select(rows, ["a", "zz"])


def test_sizes_and_specs():
    assert (parse_size("4MiB"), parse_size("512K"), parse_size("2g"), parse_size("1kb")) == (4 << 20, 512 << 10, 2 << 30, 1024)
    assert parse_spec("zstd:level=3,train") == ("zstd", {"level": "3", "train": "on"})
    for bad in ("zstd:level=1,level=2", "zstd:level=", ":x"):
        with pytest.raises(Usage):
            parse_spec(bad)
