"""Lexical analysis: word frequency, lengths, turns, search, positions, co-occurrence, dispersion, norms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """SCF-09, SCF-27 (described semantics): lower case, marks of prosody and + gone, (x) restored."""
    return F.regexp_replace(F.lower(text), r"[()+:^↑↓]", "")


def words(text: Column) -> Column:
    """Countable words (FLT-14, described semantics): maximal runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(normal(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def tokens(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(words(F.col("text"))).alias("pos", "word"))


def pattern(word: str) -> str:
    """FLT-15: a keyword as an anchored expression; * stands for any characters, nothing else matches inside a word."""
    return "^" + ".*".join(re.escape(p) for p in word.lower().split("*")) + "$"


def frequency(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-01."""
    return tokens(rows, *by).groupBy(*by, "word").agg(F.count("*").alias("n"))


def type_token(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-01: types, tokens and their ratio. Types are counted over word counts, so words combine before the shuffle."""
    f = frequency(rows, *by)
    return f.groupBy(*by).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), (F.count("*") / F.sum("n")).alias("ttr"))


def mean_length(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-02: words in an utterance; utterances without words leave the denominator."""
    n = F.size(words(F.col("text")))
    return rows.select(*by, n.alias("n")).where("n > 0").groupBy(*by).agg(F.count("*").alias("utterances"), F.sum("n").alias("words"), F.avg("n").alias("mlu"))


def mor_length(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-02: items of the %mor tier (mor) in an utterance; utterances without any leave the denominator."""
    n = F.when(F.col("mor") != "", F.size(F.split("mor", " +"))).otherwise(0)
    return rows.select(*by, n.alias("n")).where("n > 0").groupBy(*by).agg(F.count("*").alias("utterances"), F.sum("n").alias("items"), F.avg("n").alias("mlu"))


def by_kind(tokens_: DataFrame) -> DataFrame:
    """AGG-27: tokens (text, kind, parent) by text and kind: their number, and of how many parents they are."""
    one = tokens_.groupBy("text", "kind", "parent").agg(F.count("*").alias("n"))
    return one.groupBy("text", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("parents"))


def mean_turn(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-03 (described by name; a turn is a run of utterances of one speaker): utterances and words in a turn."""
    w = Window.partitionBy("file").orderBy("idx")
    new = F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(True)).cast("int")
    r = rows.withColumn("new", new).withColumns({"turn": F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.size(words(F.col("text")))})
    turns = r.groupBy("file", "turn", "speaker").agg(F.count("*").alias("u"), F.sum("n").alias("w"))
    return turns.groupBy(*by).agg(F.count("*").alias("turns"), F.avg("u").alias("mlt_utterances"), F.avg("w").alias("mlt_words"))


def word_lengths(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-04."""
    return tokens(rows, *by).groupBy(*by, F.length("word").alias("length")).agg(F.count("*").alias("n"))


def longest(rows: DataFrame, k: int) -> DataFrame:
    """CLN-05: the k longest words, ties by word."""
    return frequency(rows).select("word", "n", F.length("word").alias("length")).orderBy(F.desc("length"), "word").limit(k)


def positions(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-06: words by place in the utterance: first, last (of two or more), other."""
    t = rows.select(*by, words(F.col("text")).alias("ws")).select(*by, F.size("ws").alias("size"), F.posexplode("ws").alias("pos", "word"))
    place = F.when(F.col("pos") == 0, "first").when(F.col("pos") == F.col("size") - 1, "last").otherwise("other")
    return t.groupBy(*by, "word", place.alias("place")).agg(F.count("*").alias("n"))


def keyword(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """CLN-08: utterances in which any keyword occurs as a whole word, and the keywords' occurrences."""
    hits = F.filter(words(F.col("text")), lambda w: F.exists(F.array(*(F.lit(pattern(p)) for p in patterns)), lambda p: F.regexp_like(w, p)))
    return rows.withColumn("hits", F.size(hits)).where("hits > 0")


def together(rows: DataFrame, all_of: list[str], none_of: list[str] = ()) -> DataFrame:
    """CLN-09: utterances with all of some words and none of others."""
    ws = words(F.col("text"))
    cond = F.lit(True)
    for p in all_of:
        cond &= F.size(F.filter(ws, _like(p))) > 0
    for p in none_of:
        cond &= F.size(F.filter(ws, _like(p))) == 0
    return rows.where(cond)


def _like(word: str):
    p = pattern(word)
    return lambda w: w.rlike(p)


def cooccurrence(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-11: neighbouring words."""
    ws = rows.select(*by, words(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    pair = F.explode(F.arrays_zip(F.expr("slice(ws, 1, size(ws) - 1)").alias("a"), F.expr("slice(ws, 2, size(ws) - 1)").alias("b"))).alias("p")
    return ws.select(*by, pair).groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def distances(rows: DataFrame) -> DataFrame:
    """CLN-12: occurrences of a word in a file and the mean distance, in utterances, between one and the next."""
    t = tokens(rows, "file", "idx").select("file", "idx", "word").distinct()
    gap = F.col("idx") - F.lag("idx").over(Window.partitionBy("file", "word").orderBy("idx"))
    return t.withColumn("gap", gap).groupBy("file", "word").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"))


def imitation(rows: DataFrame) -> DataFrame:
    """CLN-13: words that an utterance shares with the one before it by another speaker."""
    w = Window.partitionBy("file").orderBy("idx")
    r = rows.withColumn("ws", F.array_distinct(words(F.col("text"))))
    r = r.withColumns({"pw": F.lag("ws").over(w), "ps": F.lag("speaker").over(w)}).where("ps <> speaker")
    return r.select("file", "idx", "speaker", F.size(F.array_intersect("ws", "pw")).alias("shared"), F.size("ws").alias("own"))


def characters(rows: DataFrame, *by: str) -> DataFrame:
    """CLN-14: characters of words by place: initial, final (of two or more), other."""
    c = tokens(rows, *by).select(*by, F.length("word").alias("size"), F.posexplode(F.split("word", "")).alias("at", "ch"))
    place = F.when(F.col("at") == 0, "initial").when(F.col("at") == F.col("size") - 1, "final").otherwise("other")
    return c.groupBy(*by, "ch", place.alias("place")).agg(F.count("*").alias("n"))


def norms(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """AGG-29 (the sample standard deviation is our choice): mean, SD and each row's z."""
    s = scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return scores.join(s, list(by)).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def against_norms(scores: DataFrame, norm: DataFrame) -> DataFrame:
    """JON-19: scores (value) with their z by the mean and SD of the norm's entries (value), which the caller has filtered."""
    s = norm.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return scores.crossJoin(F.broadcast(s)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))


def diversity(rows: DataFrame, *by: str, sizes: tuple[int, int] = (35, 50)) -> DataFrame:
    """CLN-15: D by group, of groups with more words than the largest size: for each sample size N the expected type-token ratio
    of N words drawn without replacement, x; N x^2 / (2 (1 - x)) is the D whose curve meets it; D is their mean over the sizes.

    A word seen f times among T is missing from a draw with the probability of the product of (T - f - i) / (T - i), i < N, so
    words count by how often they occur, and no sample is drawn.
    """
    f = frequency(rows, *by).groupBy(*by, "n").agg(F.count("*").alias("words"))
    total = f.groupBy(*by).agg(F.sum(F.col("n") * F.col("words")).alias("total")).where(F.col("total") > sizes[1])
    each = f.join(total, list(by)).withColumn("size", F.explode(F.sequence(F.lit(sizes[0]), F.lit(sizes[1]))))
    step = lambda p, i: p * F.greatest(F.col("total") - F.col("n") - i, F.lit(0)) / (F.col("total") - i)
    missing = F.aggregate(F.sequence(F.lit(0), F.col("size") - 1), F.lit(1.0), step)
    ttr = each.groupBy(*by, "size").agg((F.sum(F.col("words") * (1 - missing)) / F.first("size")).alias("x"))
    return ttr.groupBy(*by).agg(F.avg(F.col("size") * F.col("x") * F.col("x") / (2 * (1 - F.col("x")))).alias("d"))
