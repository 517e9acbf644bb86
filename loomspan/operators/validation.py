"""Validation rules: each finds rows (file, line, code); their union is a file's report.

Utterances are (file, line, speaker, start_ms, end_ms) with, where a rule needs them, mor, gra, pho and sin: the items of a
dependent tier as array<string>, null where there is no such tier, and words: the items of the main tier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes of a dependent tier with too few and too many items for its main tier.
COUNTS = {"mor": ("E705", "E706"), "pho": ("E714", "E715"), "sin": ("E718", "E719")}


def _coded(rows: DataFrame, code: Column) -> DataFrame:
    return rows.select("file", "line", code.alias("code")).where("code is not null")


def backwards(rows: DataFrame) -> DataFrame:
    """E701: an utterance that starts before the one before it. E362: a bullet that ends before it starts."""
    prev = F.lag("start_ms").over(Window.partitionBy("file").orderBy("line"))
    timed = rows.where("start_ms is not null").withColumn("prev", prev)
    found = F.array_compact(F.array(F.when(F.col("start_ms") < F.col("prev"), F.lit("E701")), F.when(F.col("end_ms") < F.col("start_ms"), F.lit("E362"))))
    return timed.select("file", "line", F.explode(found).alias("code"))


def self_overlap(rows: DataFrame, slack: int = 0) -> DataFrame:
    """E704: an utterance that starts before its speaker's last one ends, by more than ``slack`` ms."""
    prev = F.max("end_ms").over(Window.partitionBy("file", "speaker").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return _coded(rows.where("start_ms is not null").withColumn("prev", prev), F.when(F.col("start_ms") < F.col("prev") - slack, F.lit("E704")))


def counts(rows: DataFrame, tier: str) -> DataFrame:
    """E705 to E719: a dependent tier with fewer or more items than its main tier has words."""
    few, many = COUNTS[tier]
    n, m = F.size("words"), F.size(tier)
    return _coded(rows.where(F.col(tier).isNotNull()), F.when(m < n, F.lit(few)).when(m > n, F.lit(many)))


def graph(rows: DataFrame) -> DataFrame:
    """E722 to E724 of the items index|head|relation of gra: no root (head 0), several roots, heads that run in a circle.

    Heads are followed by doubling: after k steps each item knows its ancestor 2**k up, so a chain of n needs log n steps.
    """
    heads = F.transform("gra", lambda x: F.get(F.split(x, r"\|"), F.lit(1)).try_cast("int"))
    up = lambda p: F.transform(p, lambda x: F.coalesce(F.get(p, x - 1), F.lit(0)))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("heads") + 1)).cast("int"))
    r = rows.where("size(gra) > 0").select("file", "line", heads.alias("heads"))
    last = F.aggregate(steps, F.col("heads"), lambda p, _: up(p))
    roots = F.size(F.filter("heads", lambda x: x == 0))
    found = F.array_compact(F.array(F.when(roots == 0, F.lit("E722")).when(roots > 1, F.lit("E723")), F.when(F.exists(last, lambda x: x > 0), F.lit("E724"))))
    return r.select("file", "line", F.explode(found).alias("code"))


def report(rows: DataFrame, *rules) -> DataFrame:
    """All rules over the same rows, as (file, line, code)."""
    return reduce(DataFrame.unionByName, [rule(rows) for rule in rules])
