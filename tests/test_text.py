"""Text expressions against Python's own rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.functions import text as TX

CASES = ["a\nb", "a\r\nb\rc", "a\n", "a\n\n", "", "x\x0by\x0cz", "p\x1cq\x1dr\x1es", "u\x85v w ",
         "trailing\r\n", "\n", "no breaks", "a\n\rb"]


def test_split_lines_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i int, s string")
    got = {r.i: list(r.lines) for r in df.select("i", TX.split_lines("s").alias("lines")).collect()}
    for i, s in enumerate(CASES):
        assert got[i] == s.splitlines(), repr(s)


@pytest.mark.parametrize("x,expected", [(0.125, "12%"), (0.375, "38%"), (0.005, "0%"), (1.0, "100%"),
                                        (0.0, "0%"), (2 / 3, "67%"), (0.845, "84%"), (0.855, "86%")])
def test_percent_text_half_even(spark, x, expected):
    assert f"{x:.0%}" == expected
    got = spark.range(1).select(TX.percent_text(F.lit(x)).alias("p")).first().p
    assert got == expected


def test_token_estimate(spark):
    rows = spark.createDataFrame([("",), ("a",), ("abcd",), ("abcdefghi",)], "s string")
    got = [r.t for r in rows.select(TX.token_estimate("s").alias("t")).collect()]
    assert got == [0, 1, 1, 2]


def test_py_strip_and_description(spark):
    s = "  \t body text \x0b\n"
    got = spark.range(1).select(TX.py_strip(F.lit(s)).alias("a"), TX.pr_description(F.lit(None).cast("string")).alias("b"),
                                TX.pr_description(F.lit("x" * 1500)).alias("c")).first()
    assert got.a == s.strip()
    assert got.b == ""
    assert len(got.c) == 1000


def test_iso_to_date(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456",), ("not a date",), ("",)], "t string")
    got = [r.d for r in df.select(TX.iso_to_date("t").alias("d")).collect()]
    assert got == [dt.date(2024, 1, 2), None, None]


def test_preview(spark):
    df = spark.createDataFrame([("x" * 80,), ("y" * 81,)], "s string")
    got = [r.p for r in df.select(TX.preview("s").alias("p")).collect()]
    assert got == ["x" * 80, "y" * 80 + "…"]
