"""CLN-17: codes of %cod tiers as an ordered stream of items: frequencies, chains, what follows a code, agreement of two coders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def items(text: Column) -> Column:
    """array<struct<selector, value>> of a tier: a selector in <> belongs to the code right after it and is no code itself; one
    that nothing follows, or another selector, belongs to none."""
    found = F.regexp_extract_all(text, F.lit(r"<[^<>]*>|[^\s<>]+"), F.lit(0))
    before = F.transform(found, lambda x, i: F.struct(F.when(i > 0, F.get(found, i - 1)).alias("before"), x.alias("value")))
    selector = lambda x: F.when(x.before.startswith("<"), F.regexp_replace(x.before, "[<>]", ""))
    return F.transform(F.filter(before, lambda x: ~x.value.startswith("<")), lambda x: F.struct(selector(x).alias("selector"), x.value.alias("value")))


def stream(rows: DataFrame) -> DataFrame:
    """(file, line, speaker, nth, selector, value) of tiers (file, line, speaker, text)."""
    return rows.select("file", "line", "speaker", F.posexplode(items(F.col("text"))).alias("nth", "i")).select("file", "line", "speaker", "nth", "i.selector", "i.value")


def frequencies(codes: DataFrame) -> DataFrame:
    """CODES: how often each speaker has each code, under each of its beginnings that end before a colon and as a whole: (speaker, level, code, n)."""
    parts = F.split("value", ":")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), k), ":").alias("code")))
    return codes.select("speaker", F.inline(levels)).groupBy("speaker", "level", "code").agg(F.count("*").alias("n"))


def chains(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """CHAINS: runs of neighbouring utterances that have a code, as (file, value, first, last, size, speakers).

    ``rows`` (file, line) are all utterances: one without the code ends a run.
    """
    placed = rows.select("file", "line").distinct().withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    has = codes.groupBy("file", "line", "value").agg(F.first("speaker").alias("speaker")).join(placed, ["file", "line"])
    run = F.col("place") - F.row_number().over(Window.partitionBy("file", "value").orderBy("place"))
    return has.withColumn("run", run).groupBy("file", "value", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("size"), F.countDistinct("speaker").alias("speakers")).drop("run")


def chain_totals(chains_: DataFrame) -> DataFrame:
    return chains_.groupBy("value").agg(F.count("*").alias("chains"), F.max("size").alias("longest"), F.avg("size").alias("mean"), F.sum((F.col("speakers") > 1).cast("int")).alias("shared"))


def following(codes: DataFrame, keys: Column) -> DataFrame:
    """KEYMAP: for codes for which ``keys`` (of the column value) holds, the codes of the next utterance that has any: (speaker, value, next_speaker, next, n).

    A key at a file's end has nothing after it and is left out.
    """
    lines = codes.groupBy("file", "line").agg(F.first("speaker").alias("next_speaker"), F.sort_array(F.collect_list(F.struct("nth", "value"))).alias("all"))
    w = Window.partitionBy("file").orderBy("line")
    after = lines.select("file", "line", F.lead("next_speaker").over(w).alias("next_speaker"), F.lead("all").over(w).alias("all")).where("all is not null")
    pairs = codes.where(keys).join(after, ["file", "line"]).select("speaker", "value", "next_speaker", F.explode(F.transform("all", lambda x: x.value)).alias("next"))
    return pairs.groupBy("speaker", "value", "next_speaker", "next").agg(F.count("*").alias("n"))


def confusion(first: DataFrame, second: DataFrame) -> DataFrame:
    """RELY: (file, a, b, n): the codes that two coders gave to the same items (file, line, nth); null where one gave none."""
    a, b = (x.select("file", "line", "nth", F.col("value").alias(name)) for x, name in ((first, "a"), (second, "b")))
    return a.join(b, ["file", "line", "nth"], "full").groupBy("file", "a", "b").agg(F.count("*").alias("n"))


def kappa(matrix: DataFrame) -> DataFrame:
    """RELY: (file, items, agreed, kappa) of a confusion matrix (file, a, b, n): Cohen's kappa, null where chance alone agrees on all."""
    total = matrix.groupBy("file").agg(F.sum("n").alias("items"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agreed"))
    side = lambda c: matrix.groupBy("file", F.col(c).alias("value")).agg(F.sum("n").alias(f"n_{c}")).where("value is not null")
    chance = side("a").join(side("b"), ["file", "value"]).groupBy("file").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("both"))
    po, pe = F.col("agreed") / F.col("items"), F.coalesce("both", F.lit(0)) / (F.col("items") * F.col("items"))
    return total.join(chance, "file", "left").select("file", "items", "agreed", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
