"""Line-level operators: carry-forward, sessions, segmentation, slices, islands, monotonicity, ids by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_file():
    """Rows of a file in their order; made anew each time, as windows need a running session."""
    return Window.partitionBy("file").orderBy("line")


def carried(rows: DataFrame, column: str, out: str, first: str = "???") -> DataFrame:
    """WIN-01: the last value of ``column`` up to here; ``first`` before any."""
    return rows.withColumn(out, F.coalesce(F.last(column, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, 0)), F.lit(first)))


def sessions(rows: DataFrame, header: str) -> DataFrame:
    """WIN-08, SRC-18: each line with the text that the regular expression ``header`` (group 1) found last, if any."""
    found = F.nullif(F.regexp_extract("text", header, 1), F.lit(""))
    return rows.withColumn("session", F.last(found, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, 0)))


def anchored_codes(rows: DataFrame, code: str = r"^([A-Z]\d{3}) \(") -> DataFrame:
    """SRC-18: codes that open a line within a session."""
    return rows.where("session is not null").withColumn("code", F.regexp_extract("text", code, 1)).where("code <> ''")


def any_codes(rows: DataFrame, code: str = r"\b(E\d{3})\b") -> DataFrame:
    """SRC-19: codes anywhere on a line within a session, the header line included."""
    return rows.where("session is not null").withColumn("code", F.explode(F.regexp_extract_all("text", F.lit(code), F.lit(1))))


def labelled(rows: DataFrame) -> DataFrame:
    """WIN-03: lines (file, line, speaker, ends, n, skip) that are not skipped, each with the turn and part (utterance of the turn)
    that it lies in, and who speaks.

    speaker is null on a continuation; ends: the line holds a terminator; n: its elements that are content. A line that names
    another speaker than the current one starts a turn. Within a turn a line after one with a terminator starts an utterance,
    if the one before has any content. All windows are by file, so the lines are shuffled once.
    """
    w = by_file()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # the line before counts for its terminator even where it is skipped
    r = rows.withColumn("ended", F.coalesce(F.lag("ends").over(w), F.lit(False))).where(~F.coalesce("skip", F.lit(False)))
    r = r.withColumn("current", F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("turned", F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("current")))
    r = r.withColumns({"turn": F.sum(F.col("turned").cast("int")).over(upto), "piece": F.sum((F.col("turned") | F.col("ended")).cast("int")).over(upto)})
    # a piece without content is one with the next of its turn: parts are counted by the pieces before that have any
    piece = Window.partitionBy("file", "piece")
    r = r.withColumns({"full": (F.sum("n").over(piece) > 0).cast("int"), "opens": (F.col("line") == F.min("line").over(piece)).cast("int")})
    before = F.sum(F.col("full") * F.col("opens")).over(Window.partitionBy("file", "turn").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumns({"part": before - F.col("full"), "who": F.coalesce("speaker", "current", F.lit(""))}).drop("ended", "current", "turned", "piece", "full", "opens")


def segments(rows: DataFrame) -> DataFrame:
    """WIN-03: the utterances of :func:`labelled` lines; those without content are dropped."""
    out = labelled(rows).groupBy("file", "turn", "part").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by("who", "line").alias("speaker"), F.count("*").alias("lines"), F.sum("n").alias("n")).where("n > 0")
    return out.select("file", F.row_number().over(Window.partitionBy("file").orderBy("first_line")).cast("long").alias("utterance"), "first_line", "last_line", "speaker", "lines")


def backwards_inside(rows: DataFrame, slack: float = 0.05) -> DataFrame:
    """WIN-04: a start earlier than the line before by more than ``slack``, both over 0, counted anew at a speaker's line."""
    island = F.sum(F.col("named").cast("int")).over(by_file().rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy("file", "island").orderBy("line")
    r = rows.withColumn("island", island).withColumn("prev", F.lag("start").over(w))
    return r.where((~F.col("named")) & (F.col("start") > 0) & (F.col("prev") > 0) & (F.col("start") < F.col("prev") - slack))


def sliced(rows: DataFrame, first: int, last: int, context: int = 0) -> DataFrame:
    """FLT-06: utterances first to last (from 1) with ``context`` around, clipped to the file, with their dependent lines.

    ``kind`` is main, dependent or header; a dependent line belongs to the main line before it."""
    n = F.sum((F.col("kind") == "main").cast("int")).over(by_file().rowsBetween(Window.unboundedPreceding, 0))
    total = F.count_if(F.col("kind") == "main").over(Window.partitionBy("file"))
    r = rows.withColumns({"utt": n, "total": total})
    return r.where((F.col("kind") != "header") & F.col("utt").between(F.greatest(F.lit(first - context), F.lit(1)), F.least(F.lit(last + context), F.col("total")))).drop("total")


#: Names with ids of their own.
SPECIAL = {"TOM_1": "TOM1", "TOM_2": "TOM2", "TOM_3": "TOM3", "AUD_1": "AUD1", "AUD_2": "AUD2", "AUD_3": "AUD3", "SHANE": "SHAN", "SHARON": "SHA", "KEN": "KEN", "KENDRA": "KEND"}


def speaker_id(name: Column) -> Column:
    """SCF-04: a name's id: without marks before it, its own id if it has one, else its first four letters."""
    bare = F.regexp_replace(name, r"^>*#*\**", "")
    own = F.element_at(F.create_map(*(F.lit(x) for kv in SPECIAL.items() for x in kv)), bare)
    return F.coalesce(own, F.substring(bare, 1, 4))


def speaker_ids(rows: DataFrame) -> DataFrame:
    """WIN-12: an id for each speaker name of a file, by first appearance; the nth name (from 0) whose id is taken is JUNKn."""
    names = rows.groupBy("file", "speaker").agg(F.min("line").alias("at")).withColumn("id", speaker_id(F.col("speaker")))
    taken = F.row_number().over(Window.partitionBy("file", "id").orderBy("at", "speaker")) > 1
    r = names.withColumn("taken", taken)
    nth = F.sum(F.col("taken").cast("int")).over(Window.partitionBy("file").orderBy("at", "speaker").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return r.withColumn("nth", nth).select("file", "speaker", F.when(F.col("taken"), F.concat(F.lit("JUNK"), F.col("nth").cast("string"))).otherwise(F.col("id")).alias("id"))


def with_numbers(rows: DataFrame) -> DataFrame:
    """CLN-21 (LINES): each line's text with its number in the file before it."""
    return rows.withColumn("text", F.concat(F.row_number().over(by_file()).cast("string"), F.lit(" "), F.col("text")))


def names_by_id(names: DataFrame) -> DataFrame:
    """JON-12: for each id the first, in their order, of the names (name, id) that have it."""
    return names.groupBy("id").agg(F.min("name").alias("name"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """STR-04: consecutive rows of a file in chunks of at most ``size``."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(by_file()) - 1) / size))


def crossing(labels: DataFrame) -> DataFrame:
    """WIN-06, WIN-05, JON-08: opens and closes (file, line, key, is_open) paired last in, first out within a key.

    By running depth: a close meets the nearest open before it at its own depth. Closes without an open do not lower the
    depth below its lowest value so far, which keeps the pairing exact on unbalanced input."""
    w = Window.partitionBy("file", "key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("is_open"), 1).otherwise(-1)
    r = labels.withColumn("sum", F.sum(sign).over(w)).withColumn("floor", F.least(F.min("sum").over(w), F.lit(0)))
    r = r.withColumns({"depth": F.col("sum") - F.col("floor") + F.when(F.col("is_open"), 0).otherwise(1)})
    lost = ~F.col("is_open") & (F.col("sum") == F.col("floor")) & (F.col("sum") < F.coalesce(F.lag("floor").over(Window.partitionBy("file", "key").orderBy("line")), F.lit(0)))
    r = r.withColumn("lost", lost)
    open_at = F.last(F.when(F.col("is_open"), F.col("line")), ignorenulls=True).over(Window.partitionBy("file", "key", "depth", "lost").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("open_line", F.when(~F.col("is_open") & ~F.col("lost"), open_at)).select("file", "key", "line", "is_open", "open_line")
