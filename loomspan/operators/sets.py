"""Set comparison, priorities, rollups and top-k over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-03, SET-04: rows added and removed, as (change, ..., times): how many more, or fewer, there are than before."""
    both = after.withColumn("times", F.lit(1)).unionByName(before.withColumn("times", F.lit(-1)))
    sign = F.when(F.col("times") > 0, "added").otherwise("removed")
    return both.groupBy(*after.columns).agg(F.sum("times").alias("times")).where("times <> 0").select(sign.alias("change"), *after.columns, F.abs("times").alias("times"))


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET-01, SET-02, SET-07: each key of either set, with where it is."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("side"))


def prior(rows: DataFrame, key: str, priority: Column) -> DataFrame:
    """SET-05, SRT-08: of the rows of a key the one of first priority."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(priority.alias("_p"), *rest)).alias("best")).select(key, *(f"best.{c}" for c in rest))


def top(rows: DataFrame, k: int, *order, by: list[str] | None = None) -> DataFrame:
    """SRT-01 to SRT-05: the first k rows in ``order``, in all or of each group."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def coverage(rows: DataFrame, file: str, value: str) -> DataFrame:
    """AGG-14: for each value (null: none) the files that hold it, and their share of all files in percent."""
    held = rows.select(file, value).distinct()
    total = held.agg(F.countDistinct(file).alias("_all"))
    n = held.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("files"))
    return n.crossJoin(F.broadcast(total)).select(value, "files", (100.0 * F.col("files") / F.col("_all")).alias("percent"))


def rollup(rows: DataFrame, flags: dict[str, Column], kind: Column, *by: str) -> DataFrame:
    """AGG-16 to AGG-18: files by group, those of each flag, and the set of kinds as one sorted text (null where there is none)."""
    kinds = F.array_join(F.array_sort(F.collect_set(kind.cast("string"))), ",")
    return rows.groupBy(*by).agg(F.count("*").alias("files"), *(F.count_if(c).alias(k) for k, c in flags.items()), F.nullif(kinds, F.lit("")).alias("kinds"))


def by_code(rows: DataFrame, code: str) -> DataFrame:
    """AGG-19: warnings (file, code) by code: all of them, and the files that have any."""
    one = rows.groupBy(code, "file").agg(F.count("*").alias("n"))
    return one.groupBy(code).agg(F.sum("n").alias("total"), F.count("*").alias("files"))


def code_table(rows: DataFrame, by: str, codes: list[str]) -> DataFrame:
    """AGG-20: rows by group, those with a code, and a column for each of ``codes``."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count("code").alias("with_warning"), *(F.count_if(F.col("code") == c).alias(c) for c in codes))


def mapped(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """JON-14: rows with what a small table says of their key."""
    return rows.join(names, key)


def split(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JON-15, JON-18: rows with ``hit``, whether their key is known."""
    return rows.join(known.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def better(groups_a: Column, groups_b: Column, timed_a: Column, timed_b: Column) -> Column:
    """ITR-06: of a global (a) and a two-pass result (b) the one with more groups; of as many, two-pass unless it has fewer timed."""
    return F.when(groups_b < groups_a, "global").when((groups_b > groups_a) | (timed_b >= timed_a), "two-pass").otherwise("global")


def located(results: DataFrame, *known: DataFrame) -> DataFrame:
    """EXP-11: results (name) with the path of the first of ``known`` (name, path) that has the name, else the name."""
    out = results
    for n, k in enumerate(known):
        out = out.join(k.select("name", F.col("path").alias(f"_path{n}")), "name", "left")
    return out.withColumn("path", F.coalesce(*(F.col(f"_path{n}") for n in range(len(known))), "name")).drop(*(f"_path{n}" for n in range(len(known))))


def ghosts(described: DataFrame, with_files: DataFrame, key: str) -> DataFrame:
    """EXP-14: what has metadata but no files."""
    return described.join(with_files, key, "left_anti")


def shared(a: Column, b: Column) -> Column:
    """SET-07: how many different words two arrays have in common."""
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


def commonest(rows: DataFrame, value: str, order: str, k: int = 0) -> DataFrame:
    """SRT-02, SRT-03: values by count, ties by their first row in ``order``; the first k (0: all)."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first", value)
    return (n.limit(k) if k else n).drop("_first")


def examples(rows: DataFrame, labels: list[tuple[str, Column]], n: int, *order) -> DataFrame:
    """SRT-07: the first ``n`` rows, in ``order``, of each label; a row has the first label whose condition holds."""
    label = F.coalesce(*(F.when(c, F.lit(name)) for name, c in labels))
    return top(rows.withColumn("label", label).where("label is not null"), n, *order, by=["label"])


def subcorpus(path: Column, prefix: Column) -> Column:
    """AGG-05: up to two path components after the common prefix."""
    rest = F.split(F.regexp_replace(F.substr(path, F.length(prefix) + 1), "^/", ""), "/")
    return F.array_join(F.slice(rest, 1, F.least(F.lit(2), F.size(rest) - 1)), "/")


def histogram_text(codes: DataFrame, *by: str) -> DataFrame:
    """EXP-06: codes with their counts as one text, commonest first: ``E347(69) E348(9)``."""
    n = codes.groupBy(*by, "code").agg(F.count("*").alias("n"))
    held = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "code")))
    return n.groupBy(*by).agg(F.sum("n").alias("errors"), F.array_join(F.transform(held, lambda x: F.concat(x.code, F.lit("("), (-x.m).cast("string"), F.lit(")"))), " ").alias("codes"))


def winner(a: Column, b: Column, c: Column) -> Column:
    """EXP-07: global unless a later one is strictly greater; all equal: tie."""
    return F.when((a == b) & (b == c), "tie").when((c > a) & (c > b), "third").when(b > a, "second").otherwise("global")
