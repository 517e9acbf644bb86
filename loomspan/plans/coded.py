"""Queries on codes of %cod tiers, written from the events of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import codes
from loomspan.plans.registry import query
from loomspan.sources import tables
from loomspan.sources.tables import TIMED_SQL

#: c: the items of each event's tier: a code of its type and kind, for every other one a second code, for every third of these a third.
_COD_SQL = f"""{TIMED_SQL}, c AS (SELECT file, idx AS line, upper(left(speaker, 3)) AS speaker, id, CAST(unnest([0, 1, 2]) AS INT) AS nth, unnest([CASE WHEN id % 4 > 0 THEN 'w' || id % 4 END, NULL, 'w2-3']) AS selector,
  unnest(['$' || speaker || ':' || CASE WHEN id % 3 = 0 THEN 'NA' ELSE 'OK' END || CASE WHEN id % 5 = 0 THEN ':X' || file % 3 ELSE '' END, CASE WHEN id % 2 = 0 THEN 'PL' || id % 7 END, CASE WHEN id % 6 = 0 THEN '00:' || 10 + id % 50 END]) AS value FROM e), k AS (SELECT * FROM c WHERE value IS NOT NULL)"""


def _tiers(spark, sf):
    e, i = tables.timed(spark, sf), F.col("id")
    number = lambda n: (i % n).cast("string")
    first = F.concat(F.lit("$"), F.col("speaker"), F.lit(":"), F.when(i % 3 == 0, "NA").otherwise("OK"), F.when(i % 5 == 0, F.concat(F.lit(":X"), (F.col("file") % 3).cast("string"))).otherwise(""))
    text = F.concat(F.when(i % 4 > 0, F.concat(F.lit("<w"), number(4), F.lit("> "))).otherwise(""), first, F.when(i % 2 == 0, F.concat(F.lit(" PL"), number(7))).otherwise(""), F.when(i % 6 == 0, F.concat(F.lit(" <wl> <w2-3>00:"), (i % 50 + 10).cast("string"))).otherwise(""), F.when(i % 9 == 0, " <w9>").otherwise(""))
    return e.select("file", F.col("idx").alias("line"), "id", F.upper(F.left("speaker", F.lit(3))).alias("speaker"), text.alias("text"))


@query("cln17_items", f"WITH {_COD_SQL} SELECT file, line, speaker, nth, selector, value FROM k")
def _(spark, sf):
    return codes.stream(_tiers(spark, sf))


@query("cln17_codes", f"WITH {_COD_SQL}, p AS (SELECT speaker, string_split(value, ':') AS ps FROM k), l AS (SELECT speaker, ps, unnest(range(1, len(ps) + 1)) AS level FROM p) SELECT speaker, CAST(level AS INT) AS level, array_to_string(ps[1:level], ':') AS code, count(*) AS n FROM l GROUP BY ALL")
def _(spark, sf):
    return codes.frequencies(codes.stream(_tiers(spark, sf)))


@query("cln17_chains", f"""WITH {_COD_SQL}, h AS (SELECT file, value, line, min(speaker) AS speaker, line - row_number() OVER (PARTITION BY file, value ORDER BY line) AS run FROM k GROUP BY file, value, line), r AS (SELECT file, value, run, count(*) AS size, count(DISTINCT speaker) AS speakers FROM h GROUP BY ALL)
  SELECT value, count(*) AS chains, max(size) AS longest, avg(size) AS mean, CAST(count_if(speakers > 1) AS BIGINT) AS shared FROM r GROUP BY value""")
def _(spark, sf):
    t = _tiers(spark, sf)
    return codes.chain_totals(codes.chains(codes.stream(t), t))


@query("cln17_keymap", f"""WITH {_COD_SQL}, n AS (SELECT a.speaker, a.value, b.speaker AS next_speaker, b.value AS next FROM k a JOIN k b ON a.file = b.file AND b.line = a.line + 1 WHERE a.value LIKE '$%:NA%') SELECT *, count(*) AS n FROM n GROUP BY ALL""")
def _(spark, sf):
    return codes.following(codes.stream(_tiers(spark, sf)), F.col("value").rlike(r"^\$.*:NA"))


@query("cln17_rely", f"""WITH {_COD_SQL}, a AS (SELECT file, line, nth, value FROM k), b AS (SELECT file, line, nth, CASE WHEN id % 8 = 0 THEN '$other' ELSE value END AS value FROM k WHERE NOT (id % 13 = 0 AND nth = 0)),
  m AS (SELECT coalesce(a.file, b.file) AS file, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.file = b.file AND a.line = b.line AND a.nth = b.nth), t AS (SELECT file, count(*) AS items, count_if(a = b) AS agreed FROM m GROUP BY file),
  x AS (SELECT file, a AS value, count(*) AS na FROM m WHERE a IS NOT NULL GROUP BY ALL), y AS (SELECT file, b AS value, count(*) AS nb FROM m WHERE b IS NOT NULL GROUP BY ALL), ch AS (SELECT file, sum(na * nb) AS meet FROM x JOIN y USING (file, value) GROUP BY file)
  SELECT file, items, CAST(agreed AS BIGINT) AS agreed, CASE WHEN coalesce(meet, 0) < items * items THEN (agreed / items - coalesce(meet, 0) / (items * items)) / (1 - coalesce(meet, 0) / (items * items)) END AS kappa FROM t LEFT JOIN ch USING (file)""")
def _(spark, sf):
    t = _tiers(spark, sf)
    one = codes.stream(t).join(t.select("file", "line", "id"), ["file", "line"])
    other = one.where(~((F.col("id") % 13 == 0) & (F.col("nth") == 0))).withColumn("value", F.when(F.col("id") % 8 == 0, "$other").otherwise(F.col("value")))
    return codes.kappa(codes.confusion(one, other))
