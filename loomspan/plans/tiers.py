"""Queries on main tiers written from the words of conversations: nested groups, retracings, events, overlap marks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import groups, lexical, overlaps
from loomspan.plans.queries import U_SQL, WORDS_SQL
from loomspan.plans.registry import query
from loomspan.sources import tables

#: w: the words of an utterance with their places k from 0, and their number n. In each whole stretch of eight words from place 0 on, words
#: 0 to 5 are a group that is said again, words 1 to 3 one inside it, words 2 and 3 one inside that, said again too in every third stretch.
#: Word 3 of a stretch is followed by an event of MOT, word 5 by one of FAT, word 6 (outside) by one of SIS.
_TIER_SQL = f"""{U_SQL}, v AS (SELECT file, idx, speaker, {WORDS_SQL} AS ws FROM u), w AS (SELECT file, idx, speaker, unnest(ws) AS word, unnest(range(0, len(ws))) AS k, len(ws) AS n FROM v), s AS (SELECT *, k // 8 AS q, k % 8 AS r, (k // 8 + 1) * 8 <= n AS whole FROM w)"""


def _tiers(spark, sf):
    """(file, idx, speaker, text) as said above."""
    u = tables.utterances(spark, sf).withColumn("ws", lexical.words(F.col("text"))).where("ws is not null")
    whole = lambda k: (F.floor(k / 8) + 1) * 8 <= F.size("ws")

    def written(w, k):
        r, q = k % 8, F.floor(k / 8)
        before = F.when(r == 0, "<").when(r == 1, "<").when(r == 2, "<").otherwise("")
        inner = F.concat(F.lit(" &*MOT:oh_"), w, F.when(q % 3 == 0, "> [/] > [?] [!]").otherwise("> [=! x] > [?] [!]"))
        after = F.when(r == 3, inner).when(r == 5, F.concat(F.lit(" &*FAT:"), w, F.lit("> [//]"))).when(r == 6, F.concat(F.lit(" &*SIS:yes"))).otherwise("")
        return F.when(whole(k), F.concat(before, w, after)).otherwise(w)

    return u.select("file", "idx", "speaker", F.concat(F.array_join(F.transform("ws", written), " "), F.lit(" .")).alias("text"))


@query("src26_groups", f"""WITH {_TIER_SQL} SELECT file, idx, CAST(q * 3 + unnest([1, 2, 3]) AS INT) AS "group", CAST(unnest([0, q * 3 + 1, q * 3 + 2]) AS INT) AS parent, CAST(unnest([1, 2, 3]) AS INT) AS depth, unnest(['[//]', '[?] [!]', CASE WHEN q % 3 = 0 THEN '[/]' ELSE '[=! x]' END]) AS marks, true AS retraced FROM s WHERE whole AND r = 0""")
def _(spark, sf):
    return groups.groups(_tiers(spark, sf), "file", "idx").select("file", "idx", "group", "parent", "depth", F.array_join("marks", " ").alias("marks"), "retraced")


@query("flt14_flt16_countable", f"""WITH {_TIER_SQL} SELECT file, idx, word, count(*) AS n FROM s WHERE NOT whole OR r >= 6 GROUP BY ALL""")
def _(spark, sf):
    kept = groups.countable(groups.words(_tiers(spark, sf), "file", "idx"))
    return kept.groupBy("file", "idx", "word").agg(F.count("*").alias("n"))


@query("exp01_events", f"""WITH {_TIER_SQL}, e AS (SELECT file, idx, speaker, q, r, word FROM s WHERE whole AND r IN (3, 5, 6)), o AS (SELECT file, idx, CAST(row_number() OVER (PARTITION BY file, idx ORDER BY r = 6, q, r) AS INT) AS nth, CASE r WHEN 3 THEN 'MOT' WHEN 5 THEN 'FAT' ELSE 'SIS' END AS speaker, '+< ' || CASE r WHEN 3 THEN 'oh ' || word WHEN 5 THEN word ELSE 'yes' END || ' .' AS text FROM e),
  h AS (SELECT file, idx, speaker, string_agg(CASE WHEN whole THEN CASE r WHEN 0 THEN '<' || word WHEN 1 THEN '<' || word WHEN 2 THEN '<' || word WHEN 3 THEN word || ' ' || CASE WHEN q % 3 = 0 THEN '> [/] > [?] [!]' ELSE '> [=! x] > [?] [!]' END WHEN 5 THEN word || ' > [//]' ELSE word END ELSE word END, ' ' ORDER BY k) || ' .' AS text FROM s GROUP BY ALL)
  SELECT * FROM o UNION ALL SELECT v.file, v.idx, 0, v.speaker, replace(coalesce(h.text, ' .'), ' >', '>') FROM v LEFT JOIN h USING (file, idx) WHERE v.ws IS NOT NULL""")
def _(spark, sf):
    found = groups.events(_tiers(spark, sf), linker=True)
    # blanks before a bracket are where an event was
    return found.withColumn("text", F.when(F.col("nth") == 0, F.when(F.col("text") == ".", " .").otherwise(F.replace("text", F.lit(" >"), F.lit(">")))).otherwise(F.col("text")))


@query("jon17_balance")
def _(spark, sf):
    """Overlap marks of timed utterances: in a file, tops and bottoms of some index that have no partner."""
    e = tables.timed(spark, sf).select("file", F.col("idx").alias("line"), "id", "speaker")
    n = lambda m: F.col("id") % m
    marks = e.withColumn("top", F.when(n(3) != 1, F.array_repeat(F.when(n(4) == 0, F.lit(2)), 1 + (n(5) == 0).cast("int")))).withColumn("bottom", F.when(n(3) != 0, F.array_repeat(F.when(n(6) == 1, F.lit(2)), 1 + (n(7) == 0).cast("int"))))
    part = lambda c: marks.where(f"{c} is not null").select("file", "line", "speaker", F.lit(c).alias("side"), F.posexplode(c).alias("nth", "index"))
    return overlaps.balance(part("top").unionByName(part("bottom"))).groupBy("file").agg(F.count("*").alias("regions"), F.count_if(F.col("partners") == 0).alias("alone"), F.max("partners").alias("most"))
