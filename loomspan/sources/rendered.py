"""The tables as transcript files: events are written as raw lines, so that what parses them has something to parse.

The SQL of the queries never parses: it says from the events' columns what the parsers must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources import tables
from loomspan.sources.tables import TIMED_SQL

#: Contents of lines, and of each its elements (kind, value), how its content is written, and its last terminator.
SAMPLES = [
    ("... So you don't need to go", [("PauseMedium", ""), ("Word", "So"), ("Word", "you"), ("Word", "don't"), ("Word", "need"), ("Word", "to"), ("Word", "go")], "(...) So you don't need to go", None),
    ("yeah.", [("Word", "yeah"), ("Period", "")], "yeah", "."),
    ("(H) well, okay?", [("Inhalation", ""), ("Word", "well"), ("Comma", ""), ("Word", "okay"), ("QuestionMark", "")], "&=in well, okay", "?"),
    ("...(.5) <X word X>", [("PauseTimed", ".5"), ("LongFeatureBegin", "X"), ("Word", "word"), ("LongFeatureEnd", "X")], "(.5) &{l=X word &}l=X", None),
    ("I @ @yes @@@ --", [("Word", "I"), ("Laugh", ""), ("Word", "@yes"), ("Laughs", "3"), ("Truncation", "")], "I &=laugh yes [% laugh] &=laugh &=laugh &=laugh", "--"),
    ("[over here] [2and2]", [("Bracket", "["), ("Word", "over"), ("Word", "here"), ("Bracket", "]"), ("Bracket", "["), ("Word", "and"), ("Bracket", "]")], "⌈? over here ⌈? ⌈? and ⌈?", None),
    ("<<KNOCK>> ~Jim wo=rd %uh", [("NonvocalSimple", "KNOCK"), ("Word", "Jim"), ("Word", "wo:rd"), ("Word", "ʔuh")], "&={n=KNOCK} Jim wo:rd ʔuh", None),
    ("((DOOR)) (COUGH) /haf/ &", [("Comment", "DOOR"), ("Vocalism", "COUGH"), ("PhonologicalFragment", "haf"), ("Linker", "")], "&=door &=cough /haf/", "&"),
    ("", [], "", None),
    ("so,", [("Word", "so"), ("Comma", "")], "so,", None),
    (".", [("Period", "")], "", "."),
    ("MACHINE>> boatX> a*b", [("NonvocalEnd", "MACHINE"), ("Word", "boat"), ("LongFeatureEnd", "X"), ("Word", "a*"), ("Word", "b")], "&}n=MACHINE boat &}l=X a* b", None),
]


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_N = len(SAMPLES)
#: r: file, line, id, layout, who (null: continues), bad, zero, back, note, s (number of the sample), start and end in seconds.
RAW_SQL = f"""{TIMED_SQL}, q AS (SELECT file, idx AS line, id, CASE file % 4 WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'A' END AS layout, CASE WHEN idx = 1 OR id % 3 <> 0 THEN upper(speaker) END AS who,
  idx > 1 AND id % 13 = 0 AS bad, idx > 1 AND id % 17 = 0 AND id % 13 <> 0 AS zero, idx > 1 AND id % 11 = 0 AND id % 17 <> 0 AND id % 13 <> 0 AND id % 19 <> 0 AS back, idx > 4 AND id % 19 = 0 AS early, id % {_N} AS s FROM e),
  r AS (SELECT *, zero AND id % 2 = 0 AS note, CASE WHEN zero THEN 0.0 WHEN early THEN line - 3.75 ELSE line + 0.25 END AS start, CASE WHEN zero THEN 0.0 WHEN back THEN line - 0.5 ELSE line + 0.75 END AS "end" FROM q)"""
#: k: one row an element, as (s, i, kind, value); c: one row a sample, as (s, content, n, written, mark).
SAMPLES_SQL = (
    "k(s, i, kind, value) AS (VALUES " + ", ".join(f"({s}, {i}, {_literal(k)}, {_literal(v)})" for s, (_, es, _, _) in enumerate(SAMPLES) for i, (k, v) in enumerate(es)) + "), "
    "c(s, content, n, written, mark) AS (VALUES " + ", ".join(f"({s}, {_literal(t)}, {sum(k not in ('Period', 'QuestionMark', 'Truncation', 'Linker') for k, _ in es)}, {_literal(w)}, {_literal(m)})" for s, (t, es, w, m) in enumerate(SAMPLES)) + ")"
)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, raw): events as lines in the three layouts, with stamps and tabs that are broken here and there."""
    e = tables.timed(spark, sf_dir)
    i, line, late = F.col("id"), F.col("idx").cast("string"), F.col("idx") > 1
    bad, zero, back = late & (i % 13 == 0), late & (i % 17 == 0) & (i % 13 != 0), late & (i % 11 == 0) & (i % 17 != 0) & (i % 13 != 0) & (i % 19 != 0)
    start = F.when(bad, F.concat(F.lit("x"), line)).when(zero, "000000").otherwise(F.concat(F.when((F.col("idx") > 4) & (i % 19 == 0), F.col("idx") - 4).otherwise(F.col("idx")).cast("string"), F.lit(".25")))
    end = F.when(zero, "000000").when(back, F.concat((F.col("idx") - 1).cast("string"), F.lit(".5"))).otherwise(F.concat(line, F.lit(".75")))
    end = F.concat(end, F.when(i % 5 == 0, ":").otherwise(""))
    named = ~late | (i % 3 != 0)
    who = F.when(named, F.concat(F.upper("speaker"), F.lit(":"))).otherwise("")
    content = F.when(zero & (i % 2 == 0), "$ note").otherwise(F.get(F.array(*(F.lit(t) for t, *_ in SAMPLES)), (i % _N).cast("int")))
    tabs = lambda *xs: F.concat_ws("\t", *xs)
    times = F.concat_ws(" ", start, end)
    no_tab = late & named & (i % 7 == 0)
    raw = F.when(F.col("file") % 4 == 2, tabs(start, end, who, content)).when(F.col("file") % 4 == 3, tabs(F.concat_ws(" ", times, who), content)).when(no_tab, F.concat_ws(" ", times, who, content)).otherwise(tabs(times, who, content))
    return e.select("file", F.col("idx").alias("line"), raw.alias("raw"))


#: p: file, line, kind, name, text, start_ms, end_ms; as :func:`tier_lines` writes them.
TIERS_SQL = f"""{TIMED_SQL}, p AS (SELECT file, idx AS line, id, CASE WHEN idx = 1 THEN 'header' WHEN idx = 2 OR id % 4 = 0 THEN 'dependent' ELSE 'main' END AS kind,
  CASE WHEN idx = 1 THEN 'Media' WHEN idx = 2 OR id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'wor' ELSE 'com' END ELSE upper(left(speaker, 3)) END AS name,
  CASE WHEN idx > 1 THEN start_ms END AS start_ms, CASE WHEN idx > 1 THEN end_ms END AS end_ms, CASE WHEN idx = 1 THEN 'f' || file || ', audio' ELSE CASE WHEN id % 6 = 0 THEN '+< ' ELSE '' END || 'word ' || id || ' .' END AS bare FROM e)"""


def tier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, raw): events as headers, main and dependent tiers with bullets."""
    e = tables.timed(spark, sf_dir)
    i, first = F.col("id"), F.col("idx") == 1
    dependent = (F.col("idx") == 2) | (i % 4 == 0)
    bullet = F.coalesce(F.concat(F.lit(" \x15"), F.col("start_ms").cast("string"), F.lit("_"), F.col("end_ms").cast("string"), F.lit("\x15")), F.lit(""))
    text = F.concat(F.when(i % 6 == 0, "+< ").otherwise(""), F.lit("word "), i.cast("string"), F.lit(" ."), bullet)
    name = F.when(dependent, F.concat(F.lit("%"), F.when(i % 8 == 0, "wor").otherwise("com"))).otherwise(F.concat(F.lit("*"), F.upper(F.left("speaker", F.lit(3)))))
    raw = F.when(first, F.concat(F.lit("@Media:\tf"), F.col("file").cast("string"), F.lit(", audio"))).otherwise(F.concat(name, F.lit(":\t"), text))
    return e.select("file", F.col("idx").alias("line"), raw.alias("raw"))
