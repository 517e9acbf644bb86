"""Transcript-level operators: text coverage, gems, balance of marks, labels, media mapping, line edits.

Null texts count as empty in counts and stay null in edits; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_coverage(lines: DataFrame) -> DataFrame:
    """EXP-15: lines (file, text) that open a main tier, and those of them with digit_digit anywhere, by file."""
    main = F.coalesce(F.col("text").startswith("*"), F.lit(False))
    timed = main & F.regexp_like("text", F.lit(r"[0-9]_[0-9]"))
    return lines.groupBy("file").agg(F.count_if(main).alias("total"), F.count_if(timed).alias("timed"))


def gems(rows: DataFrame, header: Column) -> DataFrame:
    """CLN-10: rows (file, idx, ...) with ``gem``, the number of the gem they lie in; rows before the first header go."""
    n = F.sum(F.coalesce(header, F.lit(False)).cast("int")).over(Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("gem", n).where("gem > 0")


def balance(rows: DataFrame, opening: str, closing: str, *by: str) -> DataFrame:
    """AGG-25: openings and closings found by two regular expressions, and the surplus of openings."""
    count = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0))
    return rows.groupBy(*by).agg(count(opening).alias("opened"), count(closing).alias("closed")).withColumn("surplus", F.greatest(F.col("opened") - F.col("closed"), F.lit(0)))


def odd_label(label: Column, limit: int = 30) -> Column:
    """EXP-05: what is wrong with a label: an ASCII digit in it, or more than ``limit`` bytes; else null."""
    return F.when(F.regexp_like(label, F.lit("[0-9]")), "digit").when(F.octet_length(label) > limit, "long")


def mapped(path: Column, keys: list[str]) -> tuple[Column, Column]:
    """EXP-09: the first of ``keys``, in their order, that is a component of the path, and what follows it; else nulls."""
    parts = F.split(path, "/")
    key = F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.array_contains(parts, k)), 0)
    rest = F.slice(parts, F.array_position(parts, key).cast("int") + 1, F.size(parts))
    return key, F.when(key.isNotNull(), F.array_join(rest, "/"))


def delimited(text: Column) -> Column:
    """CLN-20 (DELIM): the text with a period where it has no terminator."""
    bare = F.rtrim(text)
    return F.when(F.regexp_like(bare, F.lit(r"[.?!]$")), bare).otherwise(F.concat(bare, F.lit(" .")))


def repeats(rows: DataFrame) -> DataFrame:
    """CLN-20 (REPEAT): whether the utterance (file, idx, speaker, text) says what its speaker's last one said."""
    before = F.lag("text").over(Window.partitionBy("file", "speaker").orderBy("idx"))
    return rows.withColumn("repeated", F.coalesce(F.lower("text") == F.lower(before), F.lit(False)))


def added(rows: DataFrame) -> DataFrame:
    """EXP-08: what a result adds to its input (before, after; null after: no result): %mor, %gra, timing; - for nothing; lines."""
    lines = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, "\n$", ""), "\n")))
    new = lambda mark, name: F.when(F.contains("after", F.lit(mark)) & ~F.contains("before", F.lit(mark)), F.lit(name))
    found = F.array_join(F.array_compact(F.array(new("%mor:", "%mor"), new("%gra:", "%gra"), new("\x15", "timing"))), ", ")
    return rows.withColumns({"added": F.when(F.coalesce(found, F.lit("")) == "", "-").otherwise(found), "in_lines": lines("before"), "out_lines": lines("after")})
