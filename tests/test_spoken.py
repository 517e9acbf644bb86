"""Compounds against a plain scan, numbers in letters."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import spoken

TABLE = {"a b": "AB", "a b c": "ABC", "b c": "BC", "c a b a": "CABA", "a a": "AA"}


def scanned(words):
    out, i = [], 0
    while i < len(words):
        for n in (4, 3, 2):
            key = " ".join(words[i : i + n]).lower()
            if i + n <= len(words) and key in TABLE:
                out.append(TABLE[key])
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return out


def test_compounds_are_leftmost_and_longest(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice("abcABd") for _ in range(rng.randint(0, 14))]) for i in range(300)] + [(999, None)]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, w array<string>").select("i", spoken.compounds(F.col("w"), TABLE).alias("w")).collect()}
    assert got == {i: None if w is None else scanned(w) for i, w in rows}
    with pytest.raises(ValueError):
        spoken.compounds(F.col("w"), {"one": "x"})


def test_numbers_in_letters(spark):
    want = {
        "0": "zero", "7": "seven", "13": "thirteen", "20": "twenty", "42": "forty-two", "100": "one hundred", "123": "one hundred and twenty-three", "1000": "one thousand", "1001": "one thousand and one",
        "1100": "one thousand one hundred", "12345": "twelve thousand three hundred and forty-five", "2000000": "two million", "1000000019": "one billion and nineteen", "007": "seven", "3a": "3a", "": "", "1234567890123": "1234567890123",
    }
    got = {r.x: r.y for r in spark.createDataFrame([(k,) for k in want] + [(None,)], "x string").select("x", spoken.in_letters(F.col("x")).alias("y")).collect()}
    assert got == want | {None: None}


def test_words_are_worked_out_once_not_at_every_place(spark):
    rows = spark.createDataFrame([(1, "c a b a d " * 4000)], "i int, text string")
    got = rows.select(spoken.compounds(F.split(F.trim("text"), " "), TABLE).alias("w"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert got.first().w == ["CABA", "d"] * 4000
