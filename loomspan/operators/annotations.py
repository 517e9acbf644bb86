"""Annotation sequences: classes, runs, pair frequencies, ordering rules and the order they induce."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Annotations that are classes of their own, and patterns of the others in the order of their trial.
CLASSES = {
    "[e]": "EXCLUDE", "[!*]": "BEST_GUESS", "[!!]": "CONTRASTIVE_STRESS", "[!]": "STRESSING", "[?]": "UNCERTAIN", "[/]": "RETRACE_PARTIAL", "[//]": "RETRACE_FULL",
    "[///]": "RETRACE_MULTIPLE", "[/-]": "REFORMULATION", "[/?]": "RETRACE_UNCERTAIN",
}
PATTERNS = [(r"^\[<\d*\]", "OVERLAP_BEGIN"), (r"^\[>\d*\]", "OVERLAP_END"), (r"^\[=! ", "PARALINGUISTIC"), (r"^\[=\? ", "ALTERNATIVE"), (r"^\[= ", "EXPLANATION"), (r"^\[% ", "PERCENT"), (r"^\[# ", "DURATION"), (r"^\[\*", "ERROR")]
ONE = r"\[[^\[\]]+\]"


def classify(mark: Column) -> Column:
    """SCF-13: the class of an annotation in brackets; UNKNOWN(...) for any other."""
    out = F.element_at(F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv)), mark)
    for pattern, name in PATTERNS:
        out = F.coalesce(out, F.when(mark.rlike(pattern), F.lit(name)))
    return F.coalesce(out, F.concat(F.lit("UNKNOWN("), mark, F.lit(")")))


def runs(text: Column, one: str = ONE) -> Column:
    """WIN-09: runs of two or more annotations with exactly one blank between: array<array<string>>."""
    found = F.regexp_extract_all(text, F.lit(f"{one}(?: {one})+"), F.lit(0))
    return F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(one), F.lit(0)))


def bigrams(runs_: DataFrame, column: str = "run") -> DataFrame:
    """AGG-11: neighbours (a, b) within each run."""
    fewer = F.greatest(F.size(column) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(column, F.lit(1), fewer).alias("a"), F.slice(column, F.lit(2), fewer).alias("b"))
    return runs_.select(F.inline(pairs).alias("a", "b"))


def sequences(runs_: DataFrame, *least: int, column: str = "run") -> DataFrame:
    """AGG-13: for each of the given lengths, the runs at least as long, by their classes in order: (least, run, n)."""
    each = runs_.select(F.col(column).alias("run"), F.explode(F.array(*(F.lit(n) for n in least))).alias("least")).where(F.size("run") >= F.col("least"))
    return each.groupBy("least", F.array_join("run", " ").alias("run")).agg(F.count("*").alias("n"))


def consistency(pairs: DataFrame, least: int = 20) -> DataFrame:
    """AGG-12: for each unordered pair of different classes seen ``least`` times: the commoner order and its share."""
    n = pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = n.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("a") < F.col("b"), F.col("n"))), F.lit(0)).alias("forward")
    )
    more = F.greatest("forward", F.col("total") - F.col("forward"))
    return both.where(F.col("total") >= least).select("x", "y", "total", more.alias("dominant"), (F.col("forward") * 2 >= F.col("total")).alias("x_first"), (more / F.col("total")).alias("share"))


def topological(rules: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """ITR-03: order of the classes by rules (before, after), of those that are free the first by name; and the names on or behind a cycle.

    Rules are about classes, of which there are few, whatever the number of annotations.
    """
    rules_ = set(rules)
    names = sorted({x for r in rules_ for x in r})
    waits, after = dict.fromkeys(names, 0), {n: [] for n in names}
    for a, b in rules_:
        waits[b] += 1
        after[a].append(b)
    free, out = [n for n in names if not waits[n]], []
    while free:
        out.append(heapq.heappop(free))
        for b in after[out[-1]]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(free, b)
    done = set(out)
    return out, [n for n in names if n not in done]


def ordering(pairs: DataFrame, share: float = 0.75, least: int = 20) -> DataFrame:
    """ITR-03: (place, class) of the classes by the order that AGG-12 finds for at least ``share`` of a pair's occurrences; place is null
    for classes on or behind a cycle."""
    found = consistency(pairs, least).where(F.col("share") >= share).select(F.when(F.col("x_first"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("x_first"), F.col("y")).otherwise(F.col("x")).alias("b"))
    placed, rest = topological([(r.a, r.b) for r in found.collect()])
    return pairs.sparkSession.createDataFrame([*enumerate(placed), *((None, n) for n in rest)], "place int, class string")
