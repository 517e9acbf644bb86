"""Coverage, adjacency, overlap audit, onset accuracy and timing comparison over timed utterances.

Rows are (file, idx, speaker, start_ms, end_ms); a row is timed if it has a start. All windows are by file, so a file is
the unit of distribution; aggregates combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_file():
    """Rows of a file in their order; made anew each time, as windows need a running session."""
    return Window.partitionBy("file").orderBy("idx")


def coverage(rows: DataFrame) -> DataFrame:
    """AGG-01: timed and untimed utterances by file and speaker, with a row ALL for each file."""
    timed = F.col("start_ms").isNotNull()
    g = rows.groupingSets([["file", "speaker"], ["file"]], "file", "speaker")
    out = g.agg(F.count_if(timed).alias("timed"), F.count_if(~timed).alias("untimed"), F.grouping("speaker").alias("g"))
    return out.select("file", F.when(F.col("g") == 1, "ALL").otherwise(F.col("speaker")).alias("speaker"), "timed", "untimed")


def coverage_table(rows: DataFrame) -> DataFrame:
    """SNK-04, EXP-13: coverage in the columns of its table, percent to one place; ALL for a whole file."""
    n = F.col("timed") + F.col("untimed")
    return coverage(rows).select(F.col("file").cast("string").alias("file"), "speaker", n.alias("total"), "timed", "untimed", F.when(n > 0, F.round(100.0 * F.col("timed") / n, 1)).otherwise(0.0).alias("coverage"))


def strategies(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXP-12: utterances (file, idx, start_ms, overlaps) of two reports whose times differ, and those of them that overlap by
    the first report."""
    j = a.select("file", "idx", F.col("start_ms").alias("a"), "overlaps").join(b.select("file", "idx", F.col("start_ms").alias("b")), ["file", "idx"])
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return j.groupBy("file").agg(F.count_if(differ).alias("differ"), F.count_if(differ & F.col("overlaps")).alias("differ_on_overlaps"))


def adjacent(rows: DataFrame) -> DataFrame:
    """WIN-02, JON-11: each utterance with the next one of its file, without a join."""
    n = F.lead(F.struct("speaker", "start_ms", "end_ms")).over(by_file())
    return rows.withColumn("n", n).withColumns({"next_speaker": F.col("n.speaker"), "next_start": F.col("n.start_ms"), "next_end": F.col("n.end_ms")}).drop("n")


def marked(rows: DataFrame) -> DataFrame:
    """AGG-02: which of the four overlap markers an utterance bears (``text``): top and bottom, begin and end."""
    marks = {"top_begin": "⌈", "top_end": "⌉", "bottom_begin": "⌊", "bottom_end": "⌋"}
    return rows.withColumns({k: F.contains(F.col("text"), F.lit(v)) for k, v in marks.items()})


def quality(counts: DataFrame) -> DataFrame:
    """AGG-03: pairing quality from the counts of marked utterances."""
    c = F.col
    kind = (
        F.when(c("top_begin") + c("top_end") + c("bottom_begin") + c("bottom_end") == 0, "none")
        .when((c("top_end") == 0) & (c("bottom_end") == 0), "open_only")
        .when((F.abs(c("top_begin") - c("bottom_begin")) <= 2) & (c("top_end") > 0) & (c("bottom_end") > 0), "fully_paired")
        .otherwise("mixed")
    )
    return counts.withColumn("quality", kind)


def audit(rows: DataFrame) -> DataFrame:
    """Per file: utterances, those with each marker, cross-speaker pairs, timed pairs, those consistent within 2 s, quality.

    Rows carry the four booleans of :func:`marked`. SCF-21: the bottom ends no earlier than 2 s before the top's start (0 at
    least) and starts no later than 2 s after its end.
    """
    w = by_file()
    pair = F.col("top_begin") & F.lead("bottom_begin").over(w) & (F.col("speaker") != F.lead("speaker").over(w))
    ns, ne = F.lead("start_ms").over(w), F.lead("end_ms").over(w)
    p = rows.withColumns({"pair": F.coalesce(pair, F.lit(False)), "ns": ns, "ne": ne})
    timed = F.col("pair") & F.col("start_ms").isNotNull() & F.col("ns").isNotNull()
    fine = timed & (F.col("ne") >= F.greatest(F.col("start_ms") - 2000, F.lit(0))) & (F.col("ns") <= F.col("end_ms") + 2000)
    some = F.col("top_begin") | F.col("top_end") | F.col("bottom_begin") | F.col("bottom_end")
    counts = p.groupBy("file").agg(
        F.count("*").alias("utterances"), F.count_if(some).alias("with_markers"), *(F.count_if(F.col(m)).alias(m) for m in ("top_begin", "top_end", "bottom_begin", "bottom_end")),
        F.count_if(F.col("pair")).alias("cross_pairs"), F.count_if(timed).alias("timed_pairs"), F.count_if(fine).alias("temporal_ok"),
    )
    return quality(counts)


def audit_table(audited: DataFrame) -> DataFrame:
    """SNK-05: the audit in the columns of its table."""
    marks = {"top_begin": "⌈", "top_end": "⌉", "bottom_begin": "⌊", "bottom_end": "⌋"}
    return audited.withColumn("file", F.col("file").cast("string")).withColumnsRenamed(marks)


def within_predecessor(pairs: DataFrame, slack: int = 500) -> DataFrame:
    """AGG-10: by file, utterances whose times lie within those of the last timed one before it, 500 ms a side: by the truth (a)
    and as found (b)."""
    held = F.when(F.col("t_start").isNotNull(), F.struct("t_start", "t_end"))
    p = F.last(held, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1))
    inside = lambda s, e: F.coalesce((F.col(s) >= F.col("p.t_start") - slack) & (F.col(e) <= F.col("p.t_end") + slack), F.lit(False))
    return pairs.withColumn("p", p).groupBy("file").agg(F.count_if(inside("t_start", "t_end")).alias("a_within"), F.count_if(inside("f_start", "f_end")).alias("b_within"))


def totals(audited: DataFrame, *by: str) -> DataFrame:
    """AGG-04, AGG-05: sums over the files with markers, overall or by group."""
    q = lambda k: F.count_if(F.col("quality") == k).alias(k)
    return audited.where("with_markers > 0").groupBy(*by).agg(F.count("*").alias("files"), q("fully_paired"), q("open_only"), q("mixed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cross_pairs", "timed_pairs", "temporal_ok")))


#: Places, from 0, of the index percentiles.
PLACES = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def error_stats(rows: DataFrame, error: str, *by: str) -> DataFrame:
    """AGG-06, AGG-07, AGG-09: counts within 0.5, 1, 2 s, index percentiles of |error|, mean |error| and mean error.

    The percentiles need places and not interpolation: the errors are counted by value first, so that a group's state is
    its distinct millisecond values, and the places are read off the running counts. Without groups the values are summed by
    the minute, one row of minutes tells in which of them each place lies, and only those are looked into.
    """
    e = rows.where(F.col(error).isNotNull()).select(*by, F.abs(error).alias("a"), F.col(error).alias("e"))
    values = e.groupBy(*by, "a").agg(F.count("*").alias("c"), F.sum("e").alias("s"))
    sums = values.groupBy(*by).agg(
        F.sum("c").alias("n"), *(F.coalesce(F.sum(F.when(F.col("a") <= t, F.col("c"))), F.lit(0)).alias(f"within_{t}") for t in (500, 1000, 2000)),
        (F.sum(F.col("a") * F.col("c")) / F.sum("c")).alias("mean_abs"), (F.sum("s") / F.sum("c")).alias("mean_error"),
    )
    if by:
        w = Window.partitionBy(*by)
        v = values.withColumns({"upto": F.sum("c").over(w.orderBy("a").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
        at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("a")))
        return sums.join(v.groupBy(*by).agg(*(at(x).alias(k) for k, x in PLACES.items())), list(by))
    minute = F.floor(F.col("a") / 60_000)
    minutes = values.groupBy(minute.alias("m")).agg(F.sum("c").alias("n")).agg(F.sort_array(F.collect_list(F.struct("m", "n"))).alias("h"), F.sum("n").alias("n"))
    asked = minutes.select("h", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.floor(F.col("n") * x).alias("place")) for k, x in PLACES.items()))).alias("p")).select("h", "p.*")
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("m"), F.lit(0).cast("long").alias("base"))
    found = F.aggregate("h", none, lambda s, x: F.struct((s.upto + x.n).alias("upto"), F.when(s.m.isNull() & (s.upto + x.n > F.col("place")), x.m).otherwise(s.m).alias("m"), F.when(s.m.isNull(), s.upto).otherwise(s.base).alias("base")))
    there = asked.select("name", "place", found.alias("f")).select("name", "place", "f.m", "f.base")
    inside = values.withColumn("m", minute).join(F.broadcast(there), "m")
    upto = F.col("base") + F.sum("c").over(Window.partitionBy("name").orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    hits = inside.withColumn("upto", upto).where("upto > place").agg(*(F.min(F.when(F.col("name") == k, F.col("a"))).alias(k) for k in PLACES))
    return sums.crossJoin(hits)


def onset_estimate(start: Column, end: Column, fraction: Column) -> Column:
    """SCF-20: start + trunc(fraction * duration), a negative duration counting as 0."""
    return start + (fraction * F.greatest(end - start, F.lit(0)).cast("double")).cast("long")


def compare(truth: DataFrame, found: DataFrame) -> DataFrame:
    """JON-09: ground truth and recovered utterances by file and ordinal (the shorter file decides)."""
    t = truth.select("file", "idx", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"))
    f = found.select("file", "idx", F.col("start_ms").alias("f_start"), F.col("end_ms").alias("f_end"))
    j = t.join(f, ["file", "idx"])
    return j.withColumns({"start_error": F.col("f_start") - F.col("t_start"), "end_error": F.col("f_end") - F.col("t_end")})


def comparison(pairs: DataFrame, *by: str) -> DataFrame:
    """AGG-08: timed in truth, recovered, both; regressions (timed before, not after) and new coverage."""
    t, f = F.col("t_start").isNotNull(), F.col("f_start").isNotNull()
    return pairs.groupBy(*by).agg(F.count_if(t).alias("truth"), F.count_if(f).alias("recovered"), F.count_if(t & f).alias("both"), F.count_if(t & ~f).alias("regressions"), F.count_if(~t & f).alias("new_coverage"))


def buckets(pairs: DataFrame, *by: str) -> DataFrame:
    """AGG-10: identical, up to 500 ms, over 500 ms, over 3 s apart; only in one; in neither."""
    d, t, f = F.abs("start_error"), F.col("t_start").isNotNull(), F.col("f_start").isNotNull()
    return pairs.groupBy(*by).agg(
        F.count_if(d == 0).alias("identical"), F.count_if((d > 0) & (d <= 500)).alias("close"), F.count_if(d > 500).alias("over_500"), F.count_if(d > 3000).alias("over_3000"),
        F.count_if(t & ~f).alias("a_only"), F.count_if(~t & f).alias("b_only"), F.count_if(~t & ~f).alias("neither"),
    )


def predecessor(rows: DataFrame) -> DataFrame:
    """JON-13, WIN-10: the window of the last earlier utterance that has a start."""
    held = F.when(F.col("start_ms").isNotNull(), F.struct("start_ms", "end_ms"))
    p = F.last(held, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("p", p).withColumns({"prev_start": F.col("p.start_ms"), "prev_end": F.col("p.end_ms")}).drop("p")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """JON-10: rows of a and b (file, idx, start_ms) paired by their rank within the file."""
    ranked = lambda d, n: d.select("file", F.row_number().over(by_file()).alias("nth"), F.col("start_ms").alias(n))
    return ranked(a, "a_start").join(ranked(b, "b_start"), ["file", "nth"])


def backwards(rows: DataFrame, *by: str, slack: int = 0) -> DataFrame:
    """WIN-13, E362, E701, E704 (by speaker): starts earlier than the one before, by more than ``slack``."""
    w = Window.partitionBy("file", *by).orderBy("idx")
    return rows.withColumn("prev", F.lag("start_ms").over(w)).where(F.col("start_ms") < F.col("prev") - slack).drop("prev")


def chained(words: DataFrame, floor_ms: int = 500) -> DataFrame:
    """WIN-15: a word ends where the next starts; the last at the utterance's end, or after ``floor_ms``."""
    nxt = F.lead("start_ms").over(by_file())
    return words.withColumn("word_end", F.coalesce(nxt, F.col("end_ms"), F.col("start_ms") + floor_ms))


def estimated(rows: DataFrame, weight: str, total: str) -> DataFrame:
    """WIN-14, first part: untimed utterances get a share of the file's length by their weight, widened by 2 s a side."""
    w = by_file().rowsBetween(Window.unboundedPreceding, 0)
    all_ = F.sum(weight).over(Window.partitionBy("file"))
    upto = F.sum(weight).over(w)
    lo = F.greatest(F.floor((upto - F.col(weight)) / all_ * F.col(total)) - 2000, F.lit(0))
    hi = F.floor(upto / all_ * F.col(total)) + 2000
    return rows.withColumns({"est_start": F.coalesce("start_ms", lo), "est_end": F.coalesce("end_ms", F.least(hi, F.col(total)))})


def windows(items: DataFrame, marks: DataFrame) -> DataFrame:
    """ITR-05: the nearest mark (file, key, at_ms) for an item (file, id, key, start_ms, end_ms) within ever wider windows.

    The width at which a mark first fits is its level, and wider levels hold what narrower ones do, so the nearest mark decides,
    the earlier of two as near. It is the last before the item's start or the first from there on (an item doesn't end before it
    starts): two windows over items and marks together, and no join.
    """
    a = items.select("file", "key", "id", F.col("start_ms").alias("t"), "start_ms", "end_ms", F.lit(None).cast("long").alias("at_ms"), F.lit(0).alias("kind"))
    both = a.unionByName(marks.select("file", "key", F.lit(None).cast("long").alias("id"), F.col("at_ms").alias("t"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "at_ms", F.lit(1).alias("kind")))
    w, earlier = Window.partitionBy("file", "key"), (Window.unboundedPreceding, -1)
    seen = lambda *order: F.last("at_ms", ignorenulls=True).over(w.orderBy(*order).rowsBetween(*earlier))
    near = both.withColumns({"before": seen("t", "kind", "id"), "after": seen(F.desc("t"), F.desc("kind"), F.desc("id"))}).where("kind = 0")
    gap = lambda c: F.greatest(F.col("start_ms") - F.col(c), F.col(c) - F.col("end_ms"), F.lit(0))
    best = F.least(*(F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), F.col(c).alias("at_ms"))) for c in ("before", "after")))
    d = F.col("end_ms") - F.col("start_ms")
    level = F.when(F.col("m.gap") <= 500, 1).when(F.col("m.gap") <= F.greatest(d, F.lit(2000)), 2).when(F.col("m.gap") <= F.greatest(2 * d, F.lit(5000)), 3)
    return near.withColumn("m", best).select("file", "id", level.alias("level"), "m.at_ms").where("level is not null")
