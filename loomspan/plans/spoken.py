"""Queries on what a recogniser's words become."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import lexical, spoken
from loomspan.plans.queries import U_SQL, WORDS_SQL
from loomspan.plans.registry import query
from loomspan.sources import tables

#: Compounds for the tables' invented prose.
COMPOUNDS = {"the the": "the_the", "of the": "of_the", "in the": "in_the", "of the the": "of_the_the", "die der": "die_der", "de la": "de_la"}
_ONES = ", ".join(f"'{w}'" for w in spoken.ONES)
_TENS = ", ".join(f"'{w}'" for w in spoken.TENS)


def _group(n: str) -> str:
    small = f"CASE WHEN {n} % 100 = 0 THEN '' WHEN {n} % 100 < 20 THEN ([{_ONES}])[{n} % 100 + 1] ELSE ([{_TENS}])[{n} % 100 // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN '-' || ([{_ONES}])[{n} % 10 + 1] ELSE '' END END"
    return f"(CASE WHEN {n} >= 100 THEN ([{_ONES}])[{n} // 100 + 1] || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' and ' ELSE '' END ELSE '' END || {small})"


@query("nlp02_numbers", f"""WITH p AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 5 = 0 THEN 1000 WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END + o_orderkey % 3 * 7 AS n FROM orders), g AS (SELECT k, n, n // 1000000 % 1000 AS m, n // 1000 % 1000 AS t, n % 1000 AS u FROM p),
  s AS (SELECT k, CASE WHEN n = 0 THEN 'zero' ELSE trim(CASE WHEN m > 0 THEN {_group("m")} || ' million ' ELSE '' END || CASE WHEN t > 0 THEN {_group("t")} || ' thousand ' ELSE '' END || CASE WHEN u BETWEEN 1 AND 99 AND n >= 1000 THEN 'and ' ELSE '' END || CASE WHEN u > 0 THEN {_group("u")} ELSE '' END) END AS word FROM g) SELECT k, word FROM s""")
def _(spark, sf):
    k = F.col("o_orderkey")
    n = F.floor("o_totalprice").cast("long") * F.when(k % 5 == 0, 1000).when(k % 7 == 0, 0).otherwise(1) + k % 3 * 7
    return tables.read(spark, sf, "orders").select(k.alias("k"), spoken.in_letters(n.cast("string")).alias("word"))


@query("nlp02_compounds", f"""WITH {U_SQL}, v AS (SELECT file, idx, ' ' || array_to_string({WORDS_SQL}, '  ') || ' ' AS t FROM u WHERE text IS NOT NULL),
  r AS (SELECT file, idx, regexp_replace(t, ' (of  the  the|the  the|of  the|in  the|die  der|de  la) ', ' =\\1= ', 'g') AS t FROM v) SELECT file, idx, CAST(len(regexp_extract_all(t, '=[^=]*=')) AS BIGINT) AS found, CAST(len(regexp_extract_all(t, '=of  the  the=')) AS BIGINT) AS long FROM r""")
def _(spark, sf):
    u = tables.utterances(spark, sf).where("text is not null").withColumn("w", spoken.compounds(lexical.words(F.col("text")), COMPOUNDS))
    return u.select("file", "idx", F.size(F.filter("w", lambda x: F.contains(x, F.lit("_")))).cast("long").alias("found"), F.size(F.filter("w", lambda x: x == "of_the_the")).cast("long").alias("long"))
