"""Validation rules over the lines of documents, taken as what a speaker says."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import rules
from loomspan.plans.registry import query
from loomspan.sources import tables
from loomspan.sources.tables import LINES_SQL

_ENDS = r"""(\.|\?|!|\+\.\.\.|\+\.\.\?|\+!\?|\+/\.|\+/\?|\+//\.|\+//\?|\+"/\.|\+"\.|\+\.|≈|≋)"""
_CODES = ("E220", "E231", "E232", "E233", "E242", "E246", "E305", "E306", "E312", "E313")
_WORD = {
    "E220": r"regexp_full_match(w, '[\p{L}0-9]+') AND regexp_matches(w, '\p{L}') AND regexp_matches(w, '[1-9]|.0')", "E231": r"regexp_matches(w, '\p{L}') AND length(replace(w, '(', '')) <> length(replace(w, ')', ''))",
    "E232": r"regexp_matches(w, '^[+]\p{L}|\p{L}[+]$')", "E233": r"regexp_matches(w, '\p{L}[+][+]+\p{L}')", "E246": r"regexp_matches(w, '^:+\p{L}')",
}
_LINE = {
    "E242": "length(replace(text, '“', '')) <> length(replace(text, '”', ''))", "E305": f"said <> '' AND NOT regexp_matches(said, '(^| ){_ENDS}$')", "E306": f"regexp_matches(said, '^{_ENDS}?$')",
    "E312": "length(replace(text, '[', '')) < length(replace(text, ']', ''))", "E313": "length(replace(text, '(', '')) < length(replace(text, ')', ''))",
}
_SQL = f"""WITH {LINES_SQL}, s AS (SELECT file, line, text, trim(regexp_replace(text, '\\[[^\\[\\]]*\\]', ' ', 'g')) AS said FROM l WHERE text IS NOT NULL),
  v AS (SELECT *, list_filter(string_split_regex(said, '[ \\t\\n\\x0B\\f\\r<>]+'), lambda w: w <> '' AND w[1] <> '&' AND NOT regexp_matches(w, '^[.?!,;]$|^\\+[^\\p{{L}}]|^\\([.0-9:]+\\)$')) AS ws FROM s),
  c AS (SELECT file, line, unnest([{", ".join([f"CASE WHEN {x} THEN '{c}' END" for c, x in _LINE.items()] + [f"CASE WHEN len(list_filter(ws, lambda w: {x})) > 0 THEN '{c}' END" for c, x in _WORD.items()])}]) AS code FROM v) SELECT file, line, code FROM c WHERE code IS NOT NULL"""


@query("e220_e231_e232_e233_e242_e246_e305_e306_e312_e313_lines", _SQL)
def _(spark, sf):
    lines = tables.lines(spark, sf).select("file", "line", F.concat(F.lit("*DOC:\t"), F.col("text")).alias("raw")).where("raw is not null")
    return rules.report(lines, [r for r in rules.RULES if r[0] in _CODES])


@query("e502_e504_e308_files", f"""WITH {LINES_SQL}, n AS (SELECT file, line, max(line) OVER (PARTITION BY file) AS last FROM l WHERE text IS NOT NULL) SELECT file, code, count(*) AS n FROM (SELECT file, 'E308' AS code FROM n UNION ALL SELECT file, unnest(['E502', 'E504']) FROM n WHERE line = last) GROUP BY ALL""")
def _(spark, sf):
    """Documents have no headers: every line's speaker is undeclared, and each file lacks its headers."""
    lines = tables.lines(spark, sf).select("file", "line", F.concat(F.lit("*DOC:\t"), F.col("text")).alias("raw")).where("raw is not null")
    return rules.report(lines, [r for r in rules.RULES if r[0] in ("E308", "E502", "E504")]).groupBy("file", "code").agg(F.count("*").alias("n"))
