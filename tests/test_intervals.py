"""Interval overlap join: literal cases and brute force on random data."""

import random

import pytest

from revlens.operators.intervals import functions_in_hunks


def _brute(funcs, hunks):
    out = set()
    for fid, ffile, s, e in funcs:
        for hid, hfile, hs, hl in hunks:
            if ffile == hfile and s <= hs + hl - 2 and e >= hs - 1:
                out.add((fid, hid))
    return out


def _run(spark, funcs, hunks, width=64):
    f = spark.createDataFrame(funcs, "fn_id long, file_id long, start_line int, end_line int")
    h = spark.createDataFrame(hunks, "hunk_id long, file_id long, start int, length int")
    return {(r.fn_id, r.hunk_id) for r in functions_in_hunks(f, h, bucket_lines=width).collect()}


def test_literal_cases(spark):
    funcs = [(1, 0, 0, 5), (2, 0, 0, 3), (3, 0, 0, 4)]
    hunks = [(10, 0, 3, 5), (11, 0, 10, 5), (12, 0, 5, 1)]
    got = _run(spark, funcs, hunks)
    assert (1, 10) in got          # fn 0-5, hunk (3,5) -> yes
    assert (2, 11) not in got      # fn 0-3, hunk (10,5) -> no
    assert (3, 12) in got          # fn 0-4, hunk (5,1) -> yes
    assert got == _brute(funcs, hunks)


@pytest.mark.parametrize("width", [1, 4, 64])
def test_random_against_brute_force(spark, width):
    rnd = random.Random(width)
    funcs = []
    for i in range(300):
        s = rnd.randint(0, 400)
        funcs.append((i, rnd.randint(0, 3), s, s + rnd.randint(0, 60)))
    hunks = [(1000 + j, rnd.randint(0, 3), rnd.randint(1, 450), rnd.randint(0, 30)) for j in range(120)]
    assert _run(spark, funcs, hunks, width) == _brute(funcs, hunks)
