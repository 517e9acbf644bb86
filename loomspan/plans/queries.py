"""The queries: operators bound to the tables, each with its SQL where SQL can express it. Names start with operator ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import align, annotations, brackets, chat, content, lexical, lines, metadata, sets, timing
from loomspan.plans.registry import query
from loomspan.sources import tables, transcripts
from loomspan.sources.tables import LINES_SQL, TIMED_SQL

#: Words of an utterance in SQL, as lexical.words has them.
WORDS_SQL = r"""regexp_extract_all(regexp_replace(lower(text), '[()+:^↑↓]', '', 'g'), '[\p{L}\p{N}'']+')"""
U_SQL = "u AS (SELECT conv_id AS file, turn AS idx, role AS speaker, text FROM conversations)"
T_SQL = rf"t AS (SELECT file, idx, speaker, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) - 1 AS pos, len(ws) AS size FROM (SELECT *, {WORDS_SQL} AS ws FROM u))"


# --- lexical


@query("cln01_freq", f"WITH {U_SQL}, {T_SQL} SELECT speaker, word, count(*) AS n FROM t GROUP BY ALL")
def _(spark, sf):
    return lexical.frequency(tables.utterances(spark, sf), "speaker")


@query("cln01_type_token", f"WITH {U_SQL}, {T_SQL} SELECT speaker, count(DISTINCT word) AS types, count(*) AS tokens, count(DISTINCT word) / count(*) AS ttr FROM t GROUP BY ALL")
def _(spark, sf):
    return lexical.type_token(tables.utterances(spark, sf), "speaker")


@query("cln02_mlu", f"WITH {U_SQL}, n AS (SELECT speaker, len({WORDS_SQL}) AS n FROM u) SELECT speaker, count(*) AS utterances, CAST(sum(n) AS BIGINT) AS words, avg(n) AS mlu FROM n WHERE n > 0 GROUP BY ALL")
def _(spark, sf):
    return lexical.mean_length(tables.utterances(spark, sf), "speaker")


@query("cln03_mlt", f"""WITH {U_SQL}, a AS (SELECT *, len({WORDS_SQL}) AS n, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY file ORDER BY idx) THEN 1 ELSE 0 END AS new FROM u),
b AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY idx) AS turn FROM a), c AS (SELECT file, turn, speaker, count(*) AS u, sum(n) AS w FROM b GROUP BY ALL)
SELECT speaker, count(*) AS turns, avg(u) AS mlt_utterances, avg(w) AS mlt_words FROM c GROUP BY ALL""")
def _(spark, sf):
    return lexical.mean_turn(tables.utterances(spark, sf), "speaker")


@query("cln04_wdlen", f"WITH {U_SQL}, {T_SQL} SELECT speaker, CAST(length(word) AS INT) AS length, count(*) AS n FROM t GROUP BY ALL")
def _(spark, sf):
    return lexical.word_lengths(tables.utterances(spark, sf), "speaker")


@query("cln05_maxwd", f"WITH {U_SQL}, {T_SQL} SELECT word, count(*) AS n, length(word) AS length FROM t GROUP BY word ORDER BY length DESC, word LIMIT 25")
def _(spark, sf):
    return lexical.longest(tables.utterances(spark, sf), 25)


@query("cln06_freqpos", f"WITH {U_SQL}, {T_SQL} SELECT word, CASE WHEN pos = 0 THEN 'first' WHEN pos = size - 1 THEN 'last' ELSE 'other' END AS place, count(*) AS n FROM t GROUP BY ALL")
def _(spark, sf):
    return lexical.positions(tables.utterances(spark, sf))


@query("cln07_timedur", f"WITH {TIMED_SQL} SELECT file, speaker, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM e WHERE start_ms IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return tables.timed(spark, sf).where("start_ms is not null").groupBy("file", "speaker").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


@query("cln08_kwal", rf"""WITH {U_SQL}, h AS (SELECT file, idx, len(list_filter({WORDS_SQL}, lambda w: regexp_matches(w, '^the$') OR regexp_matches(w, '^on.*$') OR regexp_matches(w, '^der$'))) AS hits FROM u)
SELECT file, idx, CAST(hits AS INT) AS hits FROM h WHERE hits > 0""")
def _(spark, sf):
    return lexical.keyword(tables.utterances(spark, sf), ["the", "on*", "der"]).select("file", "idx", "hits")


@query("cln09_combo", f"WITH {U_SQL} SELECT file, idx FROM (SELECT *, {WORDS_SQL} AS ws FROM u) WHERE list_contains(ws, 'the') AND list_contains(ws, 'and') AND NOT list_contains(ws, 'it')")
def _(spark, sf):
    return lexical.together(tables.utterances(spark, sf), ["the", "and"], ["it"]).select("file", "idx")


@query("cln11_cooccur", f"WITH {U_SQL}, {T_SQL} SELECT a.speaker, a.word AS a, b.word AS b, count(*) AS n FROM t a JOIN t b ON a.file = b.file AND a.idx = b.idx AND b.pos = a.pos + 1 GROUP BY ALL")
def _(spark, sf):
    return lexical.cooccurrence(tables.utterances(spark, sf), "speaker")


@query("cln12_dist", f"""WITH {U_SQL}, {T_SQL}, d AS (SELECT DISTINCT file, idx, word FROM t), g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY file, word ORDER BY idx) AS gap FROM d)
SELECT file, word, count(*) AS n, avg(gap) AS mean_gap FROM g GROUP BY ALL""")
def _(spark, sf):
    return lexical.distances(tables.utterances(spark, sf))


@query("cln13_chip", f"""WITH {U_SQL}, w AS (SELECT *, list_distinct({WORDS_SQL}) AS ws FROM u), p AS (SELECT *, lag(ws) OVER q AS pw, lag(speaker) OVER q AS ps FROM w WINDOW q AS (PARTITION BY file ORDER BY idx))
SELECT file, idx, speaker, CAST(len(list_intersect(ws, pw)) AS INT) AS shared, CAST(len(ws) AS INT) AS own FROM p WHERE ps <> speaker""")
def _(spark, sf):
    return lexical.imitation(tables.utterances(spark, sf))


@query("cln14_phonfreq", f"""WITH {U_SQL}, {T_SQL}, c AS (SELECT speaker, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS place_, length(word) AS n FROM t)
SELECT speaker, ch, CASE WHEN place_ = 1 THEN 'initial' WHEN place_ = n THEN 'final' ELSE 'other' END AS place, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, sf):
    return lexical.characters(tables.utterances(spark, sf), "speaker")


@query("agg29_norms", f"""WITH {U_SQL}, n AS (SELECT file, speaker, sum(len({WORDS_SQL})) AS words FROM u GROUP BY ALL), s AS (SELECT speaker, avg(words) AS mean, stddev_samp(words) AS sd FROM n GROUP BY ALL)
SELECT n.speaker, file, CAST(words AS BIGINT) AS words, mean, sd, (words - mean) / sd AS z FROM n JOIN s USING (speaker)""")
def _(spark, sf):
    n = tables.utterances(spark, sf).groupBy("file", "speaker").agg(F.sum(F.size(lexical.words(F.col("text")))).alias("words"))
    return lexical.norms(n, "words", "speaker")


# --- timing


@query("agg01_coverage", f"WITH {TIMED_SQL} SELECT file, coalesce(speaker, 'ALL') AS speaker, count(start_ms) AS timed, count(*) - count(start_ms) AS untimed FROM e GROUP BY GROUPING SETS ((file, speaker), (file))")
def _(spark, sf):
    return timing.coverage(tables.timed(spark, sf))


@query("win02_adjacent", f"WITH {TIMED_SQL} SELECT file, idx, speaker, lead(speaker) OVER w AS next_speaker, lead(start_ms) OVER w - end_ms AS gap_ms FROM e WINDOW w AS (PARTITION BY file ORDER BY idx)")
def _(spark, sf):
    return timing.adjacent(tables.timed(spark, sf)).select("file", "idx", "speaker", "next_speaker", (F.col("next_start") - F.col("end_ms")).alias("gap_ms"))


AUDIT_SQL = f"""{TIMED_SQL}, m AS (SELECT *, speaker IN ('click', 'view') AND id % 3 = 0 AS top_begin, id % 4 = 0 AND file % 3 > 0 AS top_end, id % 3 = 1 AS bottom_begin, id % 4 = 1 AND file % 3 > 0 AS bottom_end FROM e),
p AS (SELECT *, coalesce(top_begin AND lead(bottom_begin) OVER w AND speaker <> lead(speaker) OVER w, false) AS pair, lead(start_ms) OVER w AS ns, lead(end_ms) OVER w AS ne FROM m WINDOW w AS (PARTITION BY file ORDER BY idx)),
c AS (SELECT file, count(*) AS utterances, count_if(top_begin OR top_end OR bottom_begin OR bottom_end) AS with_markers, count_if(top_begin) AS top_begin, count_if(top_end) AS top_end, count_if(bottom_begin) AS bottom_begin, count_if(bottom_end) AS bottom_end,
 count_if(pair) AS cross_pairs, count_if(pair AND start_ms IS NOT NULL AND ns IS NOT NULL) AS timed_pairs, count_if(pair AND ne >= greatest(start_ms - 2000, 0) AND ns <= end_ms + 2000) AS temporal_ok FROM p GROUP BY file),
a AS (SELECT *, CASE WHEN top_begin + top_end + bottom_begin + bottom_end = 0 THEN 'none' WHEN top_end = 0 AND bottom_end = 0 THEN 'open_only' WHEN abs(top_begin - bottom_begin) <= 2 AND top_end > 0 AND bottom_end > 0 THEN 'fully_paired' ELSE 'mixed' END AS quality FROM c)"""
_COUNTS = "file, CAST(utterances AS BIGINT) AS utterances, CAST(with_markers AS BIGINT) AS with_markers, CAST(top_begin AS BIGINT) AS top_begin, CAST(top_end AS BIGINT) AS top_end, CAST(bottom_begin AS BIGINT) AS bottom_begin, CAST(bottom_end AS BIGINT) AS bottom_end, CAST(cross_pairs AS BIGINT) AS cross_pairs, CAST(timed_pairs AS BIGINT) AS timed_pairs, CAST(temporal_ok AS BIGINT) AS temporal_ok, quality"


def _audited(spark, sf):
    e, i, f = tables.timed(spark, sf), F.col("id"), F.col("file") % 3 > 0
    mark = lambda c, m: F.when(c, F.lit(m)).otherwise("")
    text = F.concat(F.lit("a "), mark(F.col("speaker").isin("click", "view") & (i % 3 == 0), "⌈"), F.lit("b "), mark((i % 4 == 0) & f, "⌉2"), mark(i % 3 == 1, "⌊"), F.lit("c"), mark((i % 4 == 1) & f, "⌋"))
    return timing.audit(timing.marked(e.withColumn("text", text)))


@query("agg02_agg03_jon11_scf21_overlap_audit", f"WITH {AUDIT_SQL} SELECT {_COUNTS} FROM a")
def _(spark, sf):
    return _audited(spark, sf)


@query("agg04_agg05_audit_totals", f"""WITH {AUDIT_SQL} SELECT CASE file % 3 WHEN 0 THEN '' WHEN 1 THEN 'c' || (file % 5) ELSE 'c' || (file % 5) || '/d' END AS subcorpus, count(*) AS files, count_if(quality = 'fully_paired') AS fully_paired, count_if(quality = 'open_only') AS open_only, count_if(quality = 'mixed') AS mixed,
CAST(sum(cross_pairs) AS BIGINT) AS cross_pairs, CAST(sum(timed_pairs) AS BIGINT) AS timed_pairs, CAST(sum(temporal_ok) AS BIGINT) AS temporal_ok FROM a WHERE with_markers > 0 GROUP BY ALL""")
def _(spark, sf):
    folder = F.concat(F.lit("/c"), (F.col("file") % 5).cast("string"))
    path = F.concat(F.lit("/data"), F.when(F.col("file") % 3 == 0, "").when(F.col("file") % 3 == 1, folder).otherwise(F.concat(folder, F.lit("/d/e"))), F.lit("/f.cha"))
    return timing.totals(_audited(spark, sf).withColumn("subcorpus", sets.subcorpus(path, F.lit("/data"))), "subcorpus")


ONSET_SQL = f"""{TIMED_SQL}, o AS (SELECT file, idx, lead(start_ms) OVER (PARTITION BY file ORDER BY idx) - (start_ms + CAST(trunc(0.25 * greatest(end_ms - start_ms, 0)) AS BIGINT)) AS error FROM e), x AS (SELECT file, error, abs(error) AS a FROM o WHERE error IS NOT NULL)"""
_STATS = """count(*) AS n, count_if(a <= 500) AS within_500, count_if(a <= 1000) AS within_1000, count_if(a <= 2000) AS within_2000, list_sort(list(a))[count(*) // 2 + 1] AS median,
list_sort(list(a))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90, list_sort(list(a))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, avg(a) AS mean_abs, avg(error) AS mean_error"""


def _onset(spark, sf):
    e = tables.timed(spark, sf)
    nxt = F.lead("start_ms").over(timing.by_file())
    return e.withColumn("error", nxt - timing.onset_estimate(F.col("start_ms"), F.col("end_ms"), F.lit(0.25)))


@query("agg06_scf20_onset_stats", f"WITH {ONSET_SQL} SELECT {_STATS} FROM x")
def _(spark, sf):
    return timing.error_stats(_onset(spark, sf), "error")


@query("agg07_onset_by_file", f"WITH {ONSET_SQL} SELECT file, {_STATS} FROM x GROUP BY file")
def _(spark, sf):
    return timing.error_stats(_onset(spark, sf), "error", "file")


PAIR_SQL = f"""{TIMED_SQL}, j AS (SELECT file, idx, speaker, start_ms AS t_start, end_ms AS t_end, CASE WHEN id % 5 <> 0 THEN start_ms + (id % 9) * 500 - 2000 WHEN id % 7 = 0 THEN 1000 END AS f_start, CASE WHEN id % 5 <> 0 THEN end_ms + (id % 3) * 100 END AS f_end FROM e),
c AS (SELECT *, f_start - t_start AS start_error, f_end - t_end AS end_error, abs(f_start - t_start) AS d FROM j)"""


def _pairs(spark, sf):
    e, i = tables.timed(spark, sf), F.col("id")
    start = F.when(i % 5 != 0, F.col("start_ms") + (i % 9) * 500 - 2000).when(i % 7 == 0, F.lit(1000))
    found = e.withColumns({"start_ms": start, "end_ms": F.when(i % 5 != 0, F.col("end_ms") + (i % 3) * 100)})
    return timing.compare(e, found)


@query("jon09_agg08_comparison", f"WITH {PAIR_SQL} SELECT file, count(t_start) AS truth, count(f_start) AS recovered, count_if(t_start IS NOT NULL AND f_start IS NOT NULL) AS both, count_if(t_start IS NOT NULL AND f_start IS NULL) AS regressions, count_if(t_start IS NULL AND f_start IS NOT NULL) AS new_coverage FROM c GROUP BY file")
def _(spark, sf):
    return timing.comparison(_pairs(spark, sf), "file")


@query("agg09_merged_errors", f"WITH {PAIR_SQL}, x AS (SELECT start_error AS error, abs(start_error) AS a FROM c WHERE start_error IS NOT NULL) SELECT {_STATS} FROM x")
def _(spark, sf):
    return timing.error_stats(_pairs(spark, sf), "start_error")


@query("agg10_buckets", f"""WITH {PAIR_SQL} SELECT file, count_if(d = 0) AS identical, count_if(d > 0 AND d <= 500) AS close, count_if(d > 500) AS over_500, count_if(d > 3000) AS over_3000,
count_if(t_start IS NOT NULL AND f_start IS NULL) AS a_only, count_if(t_start IS NULL AND f_start IS NOT NULL) AS b_only, count_if(t_start IS NULL AND f_start IS NULL) AS neither FROM c GROUP BY file""")
def _(spark, sf):
    return timing.buckets(_pairs(spark, sf), "file")


@query("jon10_zipped", f"""WITH {TIMED_SQL}, a AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY idx) AS nth, start_ms AS a_start FROM e WHERE speaker = 'click'), b AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY idx) AS nth, start_ms AS b_start FROM e WHERE speaker = 'view')
SELECT file, CAST(nth AS INT) AS nth, a_start, b_start FROM a JOIN b USING (file, nth)""")
def _(spark, sf):
    e = tables.timed(spark, sf)
    return timing.zipped(e.where("speaker = 'click'"), e.where("speaker = 'view'"))


@query("jon13_win10_predecessor", f"""WITH {TIMED_SQL} SELECT file, idx, last_value(start_ms IGNORE NULLS) OVER w AS prev_start, last_value(end_ms IGNORE NULLS) OVER w AS prev_end FROM e WINDOW w AS (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return timing.predecessor(tables.timed(spark, sf)).select("file", "idx", "prev_start", "prev_end")


@query("win13_backwards", f"WITH {PAIR_SQL}, p AS (SELECT file, idx, f_start AS start_ms, lag(f_start) OVER (PARTITION BY file ORDER BY idx) AS prev FROM c) SELECT file, idx, start_ms FROM p WHERE start_ms < prev")
def _(spark, sf):
    p = _pairs(spark, sf).select("file", "idx", F.col("f_start").alias("start_ms"))
    return timing.backwards(p)


@query("win15_chained", f"WITH {TIMED_SQL} SELECT file, idx, coalesce(lead(start_ms) OVER (PARTITION BY file ORDER BY idx), end_ms, start_ms + 500) AS word_end FROM e")
def _(spark, sf):
    return timing.chained(tables.timed(spark, sf)).select("file", "idx", "word_end")


@query("win14_groups", f"""WITH RECURSIVE {TIMED_SQL}, b AS (SELECT file, idx, start_ms - min(start_ms) OVER (PARTITION BY file) AS s, end_ms - min(start_ms) OVER (PARTITION BY file) AS e, row_number() OVER (PARTITION BY file ORDER BY idx) AS k, count(*) OVER (PARTITION BY file) AS n FROM e),
  t AS (SELECT file, idx, CAST(coalesce(s, greatest(floor((k - 1) / n * 3600000) - 2000, 0)) AS BIGINT) AS s, CAST(coalesce(e, least(floor(k / n * 3600000) + 2000, 3600000)) AS BIGINT) AS e FROM b),
  g(file, idx, first, grp) AS (SELECT file, idx, s, CAST(0 AS BIGINT) FROM t WHERE idx = 1 UNION ALL SELECT t.file, t.idx, CASE WHEN t.e - g.first > 3600000 THEN t.s ELSE g.first END, CASE WHEN t.e - g.first > 3600000 THEN g.grp + 1 ELSE g.grp END FROM g JOIN t ON t.file = g.file AND t.idx = g.idx + 1)
  SELECT file, CAST(idx AS BIGINT) AS idx, grp AS "group" FROM g""")
def _(spark, sf):
    e = tables.timed(spark, sf).withColumns({"w": F.lit(1), "total": F.lit(3_600_000)})
    base = F.min("start_ms").over(Window.partitionBy("file"))
    e = e.withColumn("base", base).withColumns({"start_ms": F.col("start_ms") - F.col("base"), "end_ms": F.col("end_ms") - F.col("base")})
    return align.grouped(timing.estimated(e, "w", "total"), 3_600_000)


@query("agg26_group_totals", f"""WITH {TIMED_SQL} SELECT file, count(DISTINCT idx // 7) AS groups, count(*) AS utterances, CAST(sum(id % 5) AS BIGINT) AS words FROM e GROUP BY file""")
def _(spark, sf):
    e = tables.timed(spark, sf).select("file", F.floor(F.col("idx") / 7).alias("group"), (F.col("id") % 5).alias("words"))
    return align.group_totals(e)


@query("itr05_windows", f"""WITH {TIMED_SQL}, i AS (SELECT * FROM e WHERE speaker <> 'view' AND start_ms IS NOT NULL), k AS (SELECT file, id % 2 AS key, start_ms + (id % 9) * 700 - 3000 AS at_ms FROM e WHERE start_ms IS NOT NULL),
g AS (SELECT i.file, i.id, at_ms, greatest(start_ms - at_ms, at_ms - end_ms, 0) AS gap, end_ms - start_ms AS d FROM i JOIN k ON i.file = k.file AND i.id % 2 = k.key),
l AS (SELECT *, CASE WHEN gap <= 500 THEN 1 WHEN gap <= greatest(d, 2000) THEN 2 WHEN gap <= greatest(2 * d, 5000) THEN 3 END AS level FROM g)
SELECT file, id, level, at_ms FROM l WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, id ORDER BY level, gap, at_ms) = 1""")
def _(spark, sf):
    e = tables.timed(spark, sf).where("start_ms is not null").withColumn("key", F.col("id") % 2)
    return timing.windows(e.where("speaker <> 'view'"), e.select("file", "key", (F.col("start_ms") + (F.col("id") % 9) * 700 - 3000).alias("at_ms")))


@query("exp07_winner", f"""WITH {TIMED_SQL}, n AS (SELECT file, count_if(speaker = 'click') AS a, count_if(speaker = 'view') AS b, count_if(speaker = 'purchase') AS c FROM e GROUP BY file)
SELECT file, CASE WHEN a = b AND b = c THEN 'tie' WHEN c > a AND c > b THEN 'third' WHEN b > a THEN 'second' ELSE 'global' END AS winner FROM n""")
def _(spark, sf):
    n = tables.timed(spark, sf).groupBy("file").agg(*(F.count_if(F.col("speaker") == s).alias(a) for s, a in (("click", "a"), ("view", "b"), ("purchase", "c"))))
    return n.select("file", sets.winner(F.col("a"), F.col("b"), F.col("c")).alias("winner"))


# --- lines


@query("win01_carried", f"WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN line % 3 = 1 AND text <> '' THEN substr(text, 1, 4) END AS name FROM l) SELECT file, line, coalesce(last_value(name IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '???') AS speaker FROM s")
def _(spark, sf):
    s = tables.lines(spark, sf).withColumn("name", F.when((F.col("line") % 3 == 1) & (F.col("text") != ""), F.substring("text", 1, 4)))
    return lines.carried(s, "name", "speaker").select("file", "line", "speaker")


HEAD_SQL = f"""{LINES_SQL}, s AS (SELECT *, last_value(nullif(regexp_extract(text, '^([A-Z][a-z]+)[ ,]', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM l)"""


@query("win08_sessions", f"WITH {HEAD_SQL} SELECT file, line, session FROM s")
def _(spark, sf):
    return lines.sessions(tables.lines(spark, sf), r"^([A-Z][a-z]+)[ ,]").select("file", "line", "session")


@query("src18_anchored_codes", f"WITH {HEAD_SQL} SELECT file, line, regexp_extract(text, '^[A-Z][a-z]+ ([a-z]{{3,6}}) ', 1) AS code FROM s WHERE session IS NOT NULL AND regexp_matches(text, '^[A-Z][a-z]+ ([a-z]{{3,6}}) ')")
def _(spark, sf):
    return lines.anchored_codes(lines.sessions(tables.lines(spark, sf), r"^([A-Z][a-z]+)[ ,]"), r"^[A-Z][a-z]+ ([a-z]{3,6}) ").select("file", "line", "code")


@query("src19_any_codes", f"WITH {HEAD_SQL} SELECT file, line, unnest(regexp_extract_all(text, '\\b(th[a-z]+)\\b', 1)) AS code FROM s WHERE session IS NOT NULL")
def _(spark, sf):
    return lines.any_codes(lines.sessions(tables.lines(spark, sf), r"^([A-Z][a-z]+)[ ,]"), r"\b(th[a-z]+)\b").select("file", "line", "code")


@query("exp06_histogram", f"""WITH {LINES_SQL}, c AS (SELECT file, unnest(regexp_extract_all(text, '\\b(th[a-z]+)\\b', 1)) AS code FROM l), n AS (SELECT file, code, count(*) AS n FROM c GROUP BY ALL)
SELECT file, CAST(sum(n) AS BIGINT) AS errors, string_agg(code || '(' || n || ')', ' ' ORDER BY n DESC, code) AS codes FROM n GROUP BY file""")
def _(spark, sf):
    return sets.histogram_text(tables.lines(spark, sf).select("file", F.explode(F.regexp_extract_all("text", F.lit(r"\b(th[a-z]+)\b"), F.lit(1))).alias("code")), "file")


_NAMES = [">ENV", "SHARON", "SHANE", "TOM_1", "*#KENDRA", "#*KEN", "JAMIE", "JAMISON", "JAMI"]
_NAME_IDS = ["ENV", "SHA", "SHAN", "TOM1", "#KEN", "KEN", "JAMI", "JAMI", "JAMI"]


@query("win12_scf04_speaker_ids", f"""WITH {TIMED_SQL}, w AS (SELECT file, {_NAMES}[id % 9 + 1] AS speaker, {_NAME_IDS}[id % 9 + 1] AS id, min(idx) AS seen FROM e GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY file, id ORDER BY seen) > 1 AS taken FROM w)
  SELECT file, speaker, CASE WHEN taken THEN 'JUNK' || (count_if(taken) OVER (PARTITION BY file ORDER BY seen) - 1) ELSE id END AS id FROM t""")
def _(spark, sf):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("id") % 9).cast("int"))
    return lines.speaker_ids(tables.timed(spark, sf).select("file", F.col("idx").alias("line"), name.alias("speaker")))


@query("flt06_slice", f"""WITH {LINES_SQL}, k AS (SELECT *, CASE WHEN line = 1 THEN 'header' WHEN line % 3 = 0 THEN 'dependent' ELSE 'main' END AS kind FROM l), n AS (SELECT *, sum(CASE WHEN kind = 'main' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS utt, count_if(kind = 'main') OVER (PARTITION BY file) AS total FROM k)
SELECT file, line, kind, CAST(utt AS BIGINT) AS utt FROM n WHERE kind <> 'header' AND utt BETWEEN greatest(3 - 1, 1) AND least(5 + 1, total)""")
def _(spark, sf):
    k = tables.lines(spark, sf).withColumn("kind", F.when(F.col("line") == 1, "header").when(F.col("line") % 3 == 0, "dependent").otherwise("main"))
    return lines.sliced(k, 3, 5, 1).select("file", "line", "kind", "utt")


@query("str04_chunks", f"WITH {LINES_SQL}, c AS (SELECT file, line, (row_number() OVER (PARTITION BY file ORDER BY line) - 1) // 5 AS chunk FROM l) SELECT file, chunk, count(*) AS n, min(line) AS first_line FROM c GROUP BY ALL")
def _(spark, sf):
    return lines.chunks(tables.lines(spark, sf), 5).groupBy("file", "chunk").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("win05_win06_jon08_brackets", f"""WITH {TIMED_SQL}, l AS (SELECT file, idx AS line, id % 2 AS key, speaker IN ('click', 'view') AS is_open FROM e), d AS (SELECT *, sum(CASE WHEN is_open THEN 1 ELSE -1 END) OVER (PARTITION BY file, key ORDER BY line) AS s FROM l),
  lost AS (SELECT *, NOT is_open AND s < least(coalesce(min(s) OVER (PARTITION BY file, key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lost FROM d),
  m AS (SELECT a.file, a.key, a.line, max(b.line) AS open_line FROM lost a JOIN lost b ON a.file = b.file AND a.key = b.key AND b.is_open AND b.line < a.line AND b.s = a.s + 1 AND NOT a.is_open AND NOT a.lost GROUP BY ALL)
  SELECT l.file, l.key, l.line, l.is_open, m.open_line FROM l LEFT JOIN m USING (file, key, line)""")
def _(spark, sf):
    e = tables.timed(spark, sf).select("file", F.col("idx").alias("line"), (F.col("id") % 2).alias("key"), F.col("speaker").isin("click", "view").alias("is_open"))
    return lines.crossing(e)


# --- annotations


ANN_SQL = f"""{LINES_SQL}, w AS (SELECT file, line, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM l), x AS (SELECT file, line, list_transform(ws, lambda v: substr(v, 1, 2)) AS run FROM w),
b AS (SELECT run[i] AS a, run[i + 1] AS b FROM (SELECT run, unnest(range(1, len(run))) AS i FROM x WHERE len(run) >= 2))"""


def _annotations(spark, sf):
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return tables.lines(spark, sf).select("file", "line", F.transform(ws, lambda v: F.substring(v, 1, 2)).alias("run"))


@query("agg11_bigrams", f"WITH {ANN_SQL} SELECT a, b, count(*) AS n FROM b GROUP BY ALL")
def _(spark, sf):
    return annotations.bigrams(_annotations(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("agg12_consistency", f"""WITH {ANN_SQL}, n AS (SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS total, count_if(a < b) AS forward FROM b WHERE a <> b GROUP BY ALL)
SELECT x, y, total, greatest(forward, total - forward) AS dominant, forward * 2 >= total AS x_first, greatest(forward, total - forward) / total AS share FROM n WHERE total >= 20""")
def _(spark, sf):
    return annotations.consistency(annotations.bigrams(_annotations(spark, sf)))


@query("agg13_sequences", f"WITH {ANN_SQL} SELECT least, array_to_string(run, ' ') AS run, count(*) AS n FROM x, (VALUES (3), (4)) AS m(least) WHERE len(run) >= least GROUP BY ALL")
def _(spark, sf):
    return annotations.sequences(_annotations(spark, sf), 3, 4)


@query("agg14_tier_coverage", f"""WITH {LINES_SQL}, t AS (SELECT DISTINCT file, substr(text, 1, 2) AS tier FROM l WHERE text <> ''), n AS (SELECT tier, count(*) AS files FROM t GROUP BY tier)
SELECT tier, files, 100.0 * files / (SELECT count(DISTINCT file) FROM l) AS percent FROM n ORDER BY files DESC, tier LIMIT 20""")
def _(spark, sf):
    tier = F.when(F.col("text") != "", F.substring("text", 1, 2))
    return sets.top(sets.coverage(tables.lines(spark, sf).withColumn("tier", tier), "file", "tier"), 20, F.desc("files"), "tier")


# --- sets, rollups, top-k


@query("set01_set02_membership", "SELECT doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'a' ELSE 'b' END AS side FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b USING (doc_id)")
def _(spark, sf):
    return sets.membership(tables.read(spark, sf, "documents").where("lang = 'en'"), tables.read(spark, sf, "labels"), "doc_id")


@query("set03_set04_changes", """WITH a AS (SELECT l_partkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_partkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT 'added' AS change, k, n, count(*) AS times FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL UNION ALL SELECT 'removed', k, n, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""")
def _(spark, sf):
    l = tables.read(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("k"), F.col("l_linenumber").alias("n"), "l_orderkey")  # noqa: E741
    return sets.changes(l.where("l_orderkey % 2 = 0").drop("l_orderkey"), l.where("l_orderkey % 3 = 0").drop("l_orderkey"))


@query("set05_srt08_priority", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey, l_linenumber) = 1")
def _(spark, sf):
    l = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")  # noqa: E741
    return sets.prior(l, "l_orderkey", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)).drop("l_returnflag")


@query("srt01_stable_sort", f"WITH {TIMED_SQL} SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY coalesce(start_ms, 0), idx) AS place FROM e")
def _(spark, sf):
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.coalesce("start_ms", F.lit(0)), "idx"))
    return tables.timed(spark, sf).select("file", "id", place.cast("long").alias("place"))


@query("srt05_largest_per_group", f"WITH {PAIR_SQL} SELECT file, idx, d FROM c WHERE d > 1500 QUALIFY row_number() OVER (PARTITION BY file ORDER BY d DESC, idx) <= 5")
def _(spark, sf):
    p = _pairs(spark, sf).withColumn("d", F.abs("start_error")).where("d > 1500")
    return sets.top(p, 5, F.desc("d"), "idx", by=["file"]).select("file", "idx", "d")


@query("agg16_agg17_agg18_rollup", """SELECT lang, source, count(*) AS files, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, string_agg(DISTINCT CAST(quality AS VARCHAR), ',' ORDER BY CAST(quality AS VARCHAR)) AS kinds FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source""")
def _(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", "lang", "source").join(tables.read(spark, sf, "labels"), "doc_id", "left")
    return sets.rollup(d, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, F.col("quality"), "lang", "source")


@query("agg19_srt04_codes", "SELECT event_type AS code, count(*) AS total, count(DISTINCT user_id) AS files FROM events GROUP BY ALL ORDER BY total DESC, code LIMIT 10")
def _(spark, sf):
    e = tables.read(spark, sf, "events").select(F.col("event_type").alias("code"), F.col("user_id").alias("file"))
    return sets.top(sets.by_code(e, "code"), 10, F.desc("total"), "code")


@query("agg20_collections", "SELECT user_id % 4 AS collection, count(*) AS total, count_if(event_type <> 'view') AS with_warning, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase FROM events GROUP BY ALL")
def _(spark, sf):
    e = tables.read(spark, sf, "events").select((F.col("user_id") % 4).alias("collection"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("code"))
    return sets.code_table(e, "collection", ["click", "purchase"])


@query("src21_scf26_json", "SELECT CAST(props->>'$.k' AS BIGINT) % 10 AS k, count(*) AS n FROM events WHERE json_valid(props) GROUP BY ALL")
def _(spark, sf):
    e = tables.read(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.col("props").alias("raw"))
    return transcripts.json_lines(e, "k long").groupBy((F.col("k") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("jon14_dimension", "SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(spark, sf):
    s, n, r = (tables.read(spark, sf, t) for t in ("supplier", "nation", "region"))
    s = sets.mapped(s, "s_nationkey", n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"))
    s = sets.mapped(s, "n_regionkey", r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    return s.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("jon15_jon18_cache_split", "SELECT lang, count_if(l.doc_id IS NOT NULL) AS hits, count_if(l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def _(spark, sf):
    d, l = tables.read(spark, sf, "documents").select("doc_id", "lang"), tables.read(spark, sf, "labels")  # noqa: E741
    return sets.split(d, l, "doc_id").groupBy("lang").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("jon15_missing_media", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    d, l = tables.read(spark, sf, "documents").select("doc_id"), tables.read(spark, sf, "labels")  # noqa: E741
    return sets.split(d, l, "doc_id").where("not hit").select("doc_id")


@query("agg22_jon16_duplicates", "SELECT '10.1/X' || (page_id % 37) AS doi, count(*) AS n, count(DISTINCT page_id % 3) AS repositories FROM pages WHERE page_id % 5 > 0 GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    p = tables.read(spark, sf, "pages").select(F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("10.1/X"), (F.col("page_id") % 37).cast("string"))).alias("doi"), (F.col("page_id") % 3).alias("repository"))
    return metadata.duplicates(p)


@query("src14_html_identifiers", """WITH l AS (SELECT page_id, '10.21415/A' || (page_id % 50) AS key FROM pages WHERE page_id % 4 > 0) SELECT key, 'p' || lpad(CAST(min(page_id) AS VARCHAR), 8, '0') AS path, '10.21415/a' || substr(key, 11) AS doi FROM l GROUP BY key""")
def _(spark, sf):
    i = F.col("page_id")
    tag = F.when(i % 4 > 0, F.concat(F.lit('<a href="x">doi:10.21415/a'), (i % 50).cast("string"), F.lit('"> doi:10.21415/later'))).when(i % 8 == 0, "doi:10.21415/").otherwise("")
    path = F.concat(F.lit("p"), F.lpad(i.cast("string"), 8, "0"))
    rows = tables.read(spark, sf, "pages").select(path.alias("path"), F.explode(F.split(F.concat(F.regexp_replace("html", "doi:", ""), F.lit("\n"), tag), "\n")).alias("text"))
    return metadata.html_identifiers(rows)


def _local(spark, sf):
    p = tables.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    return p.select(
        k.cast("string").alias("path"), F.when(k % 5 != 0, F.concat(F.lit("10.99/a"), (k % 900).cast("string"))).alias("doi"), F.concat(F.lit("u"), (k % 7).cast("string")).alias("target_url"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("description"), F.when(k % 4 != 0, F.lit("en")).alias("language"), F.when(k % 6 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("bank"),
    )


def _registry(spark, sf):
    k = F.col("s_suppkey")
    return tables.read(spark, sf, "supplier").select(F.concat(F.lit("10.99/A"), (k * 11).cast("string")).alias("doi"), F.col("s_name").alias("title"), F.when(k % 6 == 0, "draft").otherwise("findable").alias("state"), F.concat(F.lit("u"), (k * 11 % 7 + (k % 4 == 0).cast("int")).cast("string")).alias("url"))


def _html(spark, sf):
    k = F.col("c_custkey")
    return tables.read(spark, sf, "customer").select(F.concat(F.lit("10.99/A"), (k * 2).cast("string")).alias("key"), k.cast("string").alias("path"), F.concat(F.lit("10.99/a"), (k * 2).cast("string")).alias("doi"))


_ENTRIES_SQL = """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 <> 0 THEN '10.99/a' || (p_partkey % 900) END AS doi, 'u' || (p_partkey % 7) AS target_url, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS description, CASE WHEN p_partkey % 4 <> 0 THEN 'en' END AS language, CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS title, p_brand AS bank FROM part),
e AS (SELECT *, upper(doi) AS key, doi IS NOT NULL AND count(doi) OVER (PARTITION BY upper(doi)) > 1 AS dup FROM p),
r AS (SELECT '10.99/A' || (s_suppkey * 11) AS r_key, CASE WHEN s_suppkey % 6 = 0 THEN 'draft' ELSE 'findable' END AS st, 'u' || (s_suppkey * 11 % 7 + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END) AS url, s_name AS r_title FROM supplier),
h AS (SELECT '10.99/A' || (c_custkey * 2) AS h_key FROM customer),
x AS (SELECT e.*, r_key, st, url, r_title FROM e LEFT JOIN r ON e.key = r.r_key AND NOT dup UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, r_key, false, r_key, st, url, r_title FROM r WHERE r_key NOT IN (SELECT key FROM e WHERE key IS NOT NULL)),
y AS (SELECT x.*, h_key FROM x LEFT JOIN h ON x.doi IS NOT NULL AND x.key = h.h_key UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, h_key, false, NULL, NULL, NULL, NULL, h_key FROM h WHERE h_key NOT IN (SELECT key FROM x WHERE key IS NOT NULL))"""
_STATUS_SQL = """CASE WHEN dup THEN 'DUPLICATE' WHEN r_key IS NOT NULL AND st = 'draft' THEN 'DRAFT' WHEN r_key IS NOT NULL AND target_url <> url THEN 'URL MISMATCH' WHEN r_key IS NOT NULL AND doi IS NULL THEN 'MANUAL MINT' WHEN h_key IS NOT NULL AND doi IS NULL AND r_key IS NULL THEN 'HTML ONLY'
 WHEN doi IS NOT NULL AND r_key IS NULL THEN 'UNREGISTERED' WHEN doi IS NOT NULL AND h_key IS NULL THEN 'HTML STALE' WHEN doi IS NULL THEN 'NEEDS DOI' WHEN description IS NULL OR language IS NULL THEN 'INCOMPLETE' ELSE 'OK' END"""
RECONCILE_SQL = f"{_ENTRIES_SQL} SELECT path, key, {_STATUS_SQL} AS status FROM y"
AUDIT_CSV_SQL = f"""{_ENTRIES_SQL} SELECT {_STATUS_SQL} AS status, '···' AS decision, coalesce(doi, r_key, '') AS doi, coalesce(title, r_title, '') AS title, coalesce(bank, '') AS bank,
  coalesce(path, CASE WHEN r_key IS NOT NULL THEN '(DataCite only) ' || r_title END, '(HTML only) ' || key) AS path, coalesce(target_url, '') AS target_url FROM y"""


@query("jon01_jon04_scf16_reconcile", RECONCILE_SQL)
def _(spark, sf):
    return metadata.reconcile(_local(spark, sf), _registry(spark, sf), _html(spark, sf)).select("path", "key", "status")


@query("agg24_snk08_status_breakdown", f"SELECT status, count(*) AS n FROM ({RECONCILE_SQL}) GROUP BY status")
def _(spark, sf):
    return metadata.breakdown(metadata.reconcile(_local(spark, sf), _registry(spark, sf), _html(spark, sf)))


@query("flt11_suspicious", f"SELECT path, key, status FROM ({RECONCILE_SQL}) WHERE status NOT IN ('OK', 'INCOMPLETE')")
def _(spark, sf):
    return metadata.suspicious(metadata.reconcile(_local(spark, sf), _registry(spark, sf), _html(spark, sf))).select("path", "key", "status")


# --- brackets


def _opens(spark, sf):
    i = F.col("id")
    e = tables.timed(spark, sf)
    return e.select("file", F.col("idx").cast("long").alias("id"), "speaker", F.col("idx").alias("line"), (i % 11).cast("int").alias("column"), (i % 6).cast("int").alias("char_offset"))


@query("jon05_edges", f"""WITH {TIMED_SQL}, o AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY idx) AS id, speaker, idx AS line, id % 11 AS col, id % 6 AS off FROM e)
SELECT a.file, a.id, max(b.id) AS target FROM o a JOIN o b ON a.file = b.file AND b.id < a.id AND a.line - b.line BETWEEN 0 AND 5 AND abs(a.col - b.col) <= 2 AND a.speaker <> b.speaker WHERE a.off > 0 GROUP BY ALL""")
def _(spark, sf):
    return brackets.edges(_opens(spark, sf)).select("file", "id", "target")


def _bracket_pairs(spark, sf):
    e = tables.timed(spark, sf)
    t = (F.col("start_ms") / 1000.0)
    return e.select("file", F.col("idx").alias("pair"), "speaker", F.col("idx").alias("line"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("index"), t.alias("t0"), (F.col("end_ms") / 1000.0).alias("t1"))


BP_SQL = f"""{TIMED_SQL}, p AS (SELECT file, idx AS pair, speaker, idx AS line, CASE WHEN id % 3 > 0 THEN id % 3 END AS ix, start_ms / 1000.0 AS t0, end_ms / 1000.0 AS t1 FROM e)"""


@query("jon06_overlapping", f"""WITH {BP_SQL} SELECT a.file, CAST(a.pair AS INT) AS a, CAST(b.pair AS INT) AS b FROM p a JOIN p b ON a.file = b.file AND b.pair < a.pair AND a.ix IS NOT DISTINCT FROM b.ix AND a.speaker <> b.speaker AND abs(a.line - b.line) <= 20
AND ((a.t0 < b.t1 + 0.2 AND b.t0 < a.t1 + 0.2) OR abs(a.line - b.line) <= 2)""")
def _(spark, sf):
    return brackets.overlapping(_bracket_pairs(spark, sf))


#: Edges that tie pairs: a pair's open bracket has the pair's number.
_LINKS_SQL = f"""{BP_SQL}, o AS (SELECT file, idx AS id, speaker, idx AS line, id % 11 AS col, id % 6 AS off FROM e), x AS (SELECT a.file, a.id, max(b.id) AS target FROM o a JOIN o b ON a.file = b.file AND b.id < a.id AND a.line - b.line BETWEEN 0 AND 5 AND abs(a.col - b.col) <= 2 AND a.speaker <> b.speaker WHERE a.off > 0 GROUP BY ALL),
  j AS (SELECT x.file, x.id AS a, x.target AS b FROM x JOIN p a ON x.file = a.file AND x.id = a.pair JOIN p b ON x.file = b.file AND x.target = b.pair WHERE a.speaker <> b.speaker AND a.ix IS NOT DISTINCT FROM b.ix)"""


@query("jon07_aligned", f"WITH {_LINKS_SQL} SELECT file, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM j")
def _(spark, sf):
    return _aligned(spark, sf)


def _aligned(spark, sf):
    return brackets.aligned(brackets.edges(_opens(spark, sf)), _bracket_pairs(spark, sf).withColumn("open_id", F.col("pair").cast("long")))


_ROLES_SQL = f"""{_LINKS_SQL}, k AS (SELECT a.file, a.pair AS a, b.pair AS b FROM p a JOIN p b ON a.file = b.file AND b.pair < a.pair AND a.ix IS NOT DISTINCT FROM b.ix AND a.speaker <> b.speaker AND abs(a.line - b.line) <= 20
AND ((a.t0 < b.t1 + 0.2 AND b.t0 < a.t1 + 0.2) OR abs(a.line - b.line) <= 2) UNION SELECT * FROM j), s AS (SELECT file, a, b FROM k UNION ALL SELECT file, b, a FROM k), g(file, root, pair) AS (SELECT file, pair, pair FROM p UNION SELECT g.file, g.root, s.b FROM g JOIN s ON g.file = s.file AND g.pair = s.a),
c AS (SELECT file, pair, min(root) AS root FROM g GROUP BY ALL), n AS (SELECT p.file, p.pair, speaker, ix, root, row_number() OVER (PARTITION BY p.file, root, speaker ORDER BY p.pair) AS nth FROM p JOIN c ON p.file = c.file AND p.pair = c.pair),
roles AS (SELECT file, CAST(pair AS INT) AS pair, CAST(nth AS INT) AS nth, ix, CASE WHEN pair = min(pair) OVER w THEN 'top' ELSE 'bottom' END AS role, CAST(coalesce(ix - 1, first_value(ix) OVER (PARTITION BY file, root, nth ORDER BY pair) - 1, 0) AS INT) AS real_index FROM n WINDOW w AS (PARTITION BY file, root, nth))"""


def _roles(spark, sf):
    p = _bracket_pairs(spark, sf)
    return brackets.sets_of(p, brackets.overlapping(p).unionByName(_aligned(spark, sf)))


@query("itr01_itr02_win11_roles", f"WITH RECURSIVE {_ROLES_SQL} SELECT file, pair, nth, role, real_index FROM roles")
def _(spark, sf):
    return _roles(spark, sf).select("file", "pair", "nth", "role", "real_index")


@query("exp04_agg21_confidence", f"""WITH RECURSIVE {_ROLES_SQL}, z AS (SELECT *, sum(1 + CASE WHEN pair % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, real_index) AS m FROM roles), ends AS (SELECT file, id FROM x UNION SELECT file, target FROM x),
  y AS (SELECT z.file, CASE WHEN ix IS NOT NULL THEN 'Original' WHEN ends.id IS NOT NULL THEN 'High' WHEN m >= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM z LEFT JOIN ends ON z.file = ends.file AND z.pair = ends.id), q AS (SELECT file, confidence, count(*) AS n FROM y GROUP BY ALL)
  SELECT file, confidence, n, n / sum(n) OVER (PARTITION BY file) AS share FROM q""")
def _(spark, sf):
    opens = _roles(spark, sf).withColumns({"id": F.col("pair").cast("long"), "closed": F.col("pair") % 2 == 0})
    return brackets.review(brackets.confidence(opens, brackets.edges(_opens(spark, sf))))


@query("scf24_exp02_marks", f"""WITH RECURSIVE {_ROLES_SQL} SELECT file, pair, CASE role WHEN 'top' THEN '⌈' ELSE '⌊' END || CASE WHEN real_index % 9 > 0 THEN CAST(real_index % 9 + 1 AS VARCHAR) ELSE '' END AS opening, CASE role WHEN 'top' THEN '⌉' ELSE '⌋' END || CASE WHEN real_index % 9 > 0 THEN CAST(real_index % 9 + 1 AS VARCHAR) ELSE '' END AS closing FROM roles""")
def _(spark, sf):
    mark = lambda is_open: content.marker(F.col("role"), F.lit(is_open), F.col("real_index"))
    return _roles(spark, sf).select("file", "pair", mark(True).alias("opening"), mark(False).alias("closing"))


# --- transcripts


@query("exp15_text_coverage", f"WITH {TIMED_SQL} SELECT file, count(*) AS total, count_if(start_ms IS NOT NULL) AS timed FROM e GROUP BY ALL")
def _(spark, sf):
    t = tables.timed(spark, sf)
    bullet = F.coalesce(F.concat(F.lit(" \x15"), "start_ms", F.lit("_"), "end_ms", F.lit("\x15")), F.lit(""))
    return chat.text_coverage(t.select("file", F.concat(F.lit("*"), "speaker", F.lit(":\t"), "id", bullet).alias("text")))


@query("cln10_gems", f"""WITH {U_SQL}, g AS (SELECT *, len({WORDS_SQL}) AS n, sum(CASE WHEN speaker = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY idx ROWS UNBOUNDED PRECEDING) AS gem FROM u)
  SELECT file, CAST(gem AS BIGINT) AS gem, count(*) AS utterances, CAST(coalesce(sum(n), 0) AS BIGINT) AS words FROM g WHERE gem > 0 GROUP BY ALL""")
def _(spark, sf):
    g = chat.gems(tables.utterances(spark, sf), F.col("speaker") == "user")
    return g.groupBy("file", "gem").agg(F.count("*").alias("utterances"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.size(lexical.words(F.col("text"))))), F.lit(0)).cast("long").alias("words"))


@query("agg25_balance", r"""SELECT doc_id, coalesce(CAST(sum(len(regexp_extract_all(text, '\('))) AS BIGINT), 0) AS opened, coalesce(CAST(sum(len(regexp_extract_all(text, '\)'))) AS BIGINT), 0) AS closed,
  greatest(opened - closed, 0) AS surplus FROM documents GROUP BY doc_id""")
def _(spark, sf):
    return chat.balance(tables.read(spark, sf, "documents"), r"\(", r"\)", "doc_id")


@query("exp05_odd_labels", f"""WITH {U_SQL}, {T_SQL}, w AS (SELECT DISTINCT word, CASE WHEN regexp_matches(word, '[0-9]') THEN 'digit' WHEN strlen(word) > 12 THEN 'long' END AS problem FROM t) SELECT * FROM w WHERE problem IS NOT NULL""")
def _(spark, sf):
    w = lexical.tokens(tables.utterances(spark, sf), "speaker").select("word").distinct()
    return w.withColumn("problem", chat.odd_label(F.col("word"), 12)).where("problem is not null")


@query("exp09_mapped_paths", """WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages), k AS (SELECT *, CASE WHEN list_contains(parts, 'es') THEN 'es' WHEN list_contains(parts, 'en') THEN 'en' END AS mapped FROM p)
  SELECT page_id, mapped, CASE WHEN mapped IS NOT NULL THEN array_to_string(parts[list_position(parts, mapped) + 1 :], '/') END AS rest FROM k""")
def _(spark, sf):
    key, rest = chat.mapped(F.col("url"), ["es", "en"])
    return tables.read(spark, sf, "pages").select("page_id", key.alias("mapped"), rest.alias("rest"))


@query("cln20_delim_repeat", f"""WITH {U_SQL} SELECT file, idx, CASE WHEN regexp_matches(rtrim(text, ' '), '[.?!]$') THEN rtrim(text, ' ') ELSE rtrim(text, ' ') || ' .' END AS text,
  coalesce(lower(text) = lower(lag(text) OVER (PARTITION BY file, speaker ORDER BY idx)), false) AS repeated FROM u""")
def _(spark, sf):
    return chat.repeats(tables.utterances(spark, sf)).select("file", "idx", chat.delimited(F.col("text")).alias("text"), "repeated")
