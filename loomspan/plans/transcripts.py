"""Queries over the tables written as transcripts (see sources.rendered), each with the SQL of what must be found."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import align, annotations, brackets, chat, content, lexical, lines, metadata, sets, timing
from loomspan.plans.registry import query
from loomspan.sources import rendered, tables, transcripts
from loomspan.sources.rendered import RAW_SQL, SAMPLES_SQL, TIERS_SQL
from loomspan.sources.tables import TIMED_SQL


def _parsed(spark, sf):
    return transcripts.parsed(rendered.raw_lines(spark, sf))


@query("src06_layouts", f"WITH {RAW_SQL} SELECT file, min(layout) AS layout FROM r GROUP BY file")
def _(spark, sf):
    return transcripts.layouts(rendered.raw_lines(spark, sf))


@query("src07_src08_src09_src10_src11_flt03_lines", f"""WITH {RAW_SQL}, {SAMPLES_SQL} SELECT file, line, layout, CASE WHEN NOT bad THEN CAST(start AS DOUBLE) END AS start, CAST("end" AS DOUBLE) AS "end", who AS speaker, CASE WHEN note THEN '$ note' ELSE content END AS content,
  CASE WHEN bad THEN 'bad stamp' WHEN zero THEN 'zero stamp' WHEN back THEN 'end before start' END AS problem FROM r JOIN c USING (s)""")
def _(spark, sf):
    return _parsed(spark, sf)


@query("src05_decoded", "SELECT doc_id, lang || 'c''é€' || source AS text FROM documents")
def _(spark, sf):
    raw = F.unhex(F.concat(F.hex("lang"), F.lit("00927F0DE980"), F.hex("source")))
    return tables.read(spark, sf, "documents").select("doc_id", transcripts.decoded(raw).alias("text"))


@query("flt01_numbered", "SELECT doc_id AS file, i AS line, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(raw, ' ') <> ''")
def _(spark, sf):
    return transcripts.numbered(tables.read(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"))


@query("scf02_scf03_elements", f"WITH {RAW_SQL}, {SAMPLES_SQL} SELECT file, line, CAST(i AS INT) AS i, kind, value FROM r JOIN k USING (s) WHERE NOT note UNION ALL SELECT file, line, CAST(unnest([0, 1]) AS INT), 'Word', unnest(['$', 'note']) FROM r WHERE note")
def _(spark, sf):
    p = transcripts.once(_parsed(spark, sf), content.elements(F.col("content")).alias("elements")).select("file", "line", F.posexplode("elements").alias("i", "e"))
    return p.select("file", "line", "i", "e.kind", "e.value")


@query("scf05_written", f"WITH {RAW_SQL}, {SAMPLES_SQL} SELECT file, line, CASE WHEN note THEN '$ note' ELSE written END AS text FROM r JOIN c USING (s)")
def _(spark, sf):
    e = F.filter(content.elements(F.col("content")), content.is_content)
    return _parsed(spark, sf).select("file", "line", content.written(F.transform(e, lambda x: content.rendered(x))).alias("text"))


@query("flt02_win01_kept", f"WITH {RAW_SQL} SELECT file, line, last_value(who IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS effective, note AS skip FROM r WHERE NOT bad")
def _(spark, sf):
    return transcripts.kept(_parsed(spark, sf)).select("file", "line", "effective", "skip")


#: u: utterances, from the lines that hold their times (l) by the rules of the segmentation.
UTTERANCES_SQL = f"""{RAW_SQL}, {SAMPLES_SQL}, l0 AS (SELECT r.*, CASE WHEN note THEN 2 ELSE c.n END AS n, CASE WHEN note THEN '$ note' ELSE c.written END AS written, CASE WHEN NOT note THEN c.mark END AS mark FROM r JOIN c USING (s) WHERE NOT bad),
  l1 AS (SELECT *, coalesce(lag(mark IN ('.', '?', '--')) OVER w, false) AS ended FROM l0 WINDOW w AS (PARTITION BY file ORDER BY line)),
  l2 AS (SELECT *, lead(start) OVER w AS next_start, last_value(who IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l1 WHERE NOT note WINDOW w AS (PARTITION BY file ORDER BY line)),
  l3 AS (SELECT *, sum(CASE WHEN who IS NOT NULL AND who IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER w AS turn, sum(CASE WHEN (who IS NOT NULL AND who IS DISTINCT FROM before) OR ended THEN 1 ELSE 0 END) OVER w AS piece FROM l2 WINDOW w AS (PARTITION BY file ORDER BY line)),
  p AS (SELECT file, turn, piece, sum(n) AS m FROM l3 GROUP BY ALL), p2 AS (SELECT *, coalesce(count_if(m > 0) OVER (PARTITION BY file, turn ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM p),
  l AS (SELECT l3.*, part FROM l3 JOIN p2 USING (file, turn, piece)),
  u AS (SELECT file, turn, part, min(line) AS first_line, max(line) AS last_line, arg_min(coalesce(who, before), line) AS speaker, count(*) AS lines, arg_min(start, line) AS start, arg_max("end", line) AS "end", arg_max(coalesce(next_start, 1e15), line) AS next_start,
    string_agg(nullif(written, ''), ' ' ORDER BY line) AS text, arg_max(mark, line) FILTER (mark IS NOT NULL) AS mark FROM l GROUP BY ALL HAVING sum(n) > 0),
  v AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_line) AS utterance, CASE WHEN mark IS NULL AND ends_with(text, ',') THEN left(text, len(text) - 1) ELSE text END AS bare,
    CASE mark WHEN '?' THEN '?' WHEN '&' THEN '+,' WHEN '--' THEN CASE WHEN next_start - "end" < 0 THEN '+/.' ELSE '+...' END ELSE '.' END AS sign FROM u)"""


@query("win03_segments", f"WITH {UTTERANCES_SQL} SELECT file, CAST(utterance AS BIGINT) AS utterance, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, speaker, lines FROM v")
def _(spark, sf):
    k = transcripts.kept(_parsed(spark, sf)).withColumn("e", content.elements(F.col("content")))
    return lines.segments(k.withColumns({"ends": F.exists("e", lambda x: x.kind.isin(*content.TERMINATORS)), "n": F.size(F.filter("e", content.is_content))}))


def _utterances(spark, sf):
    return content.utterances(transcripts.kept(_parsed(spark, sf)))


@query("scf06_scf07_marks", f"""WITH {UTTERANCES_SQL} SELECT file, CAST(utterance AS BIGINT) AS utterance, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms, bare AS text, sign AS mark FROM v""")
def _(spark, sf):
    return _utterances(spark, sf).select("file", "utterance", "start_ms", "end_ms", content.written(F.transform("elements", lambda x: content.rendered(x))).alias("text"), "mark")


#: Speakers by first appearance; those of the events have no two names of one id.
_IDS_SQL = "i AS (SELECT file, who, left(who, 4) AS id FROM r WHERE who IS NOT NULL AND NOT bad GROUP BY ALL)"


@query("snk01_documents", f"""WITH {UTTERANCES_SQL}, {_IDS_SQL}, h AS (SELECT file, '@UTF8' || chr(10) || '@Begin' || chr(10) || '@Languages:' || chr(9) || 'eng' || chr(10) || '@Participants:' || chr(9) || string_agg(id || ' Speaker', ', ' ORDER BY who) || chr(10) || '@Options:' || chr(9) || 'CA' || chr(10)
  || string_agg('@ID:' || chr(9) || 'eng|corpus|' || id || '|||||Speaker|||', chr(10) ORDER BY who) || chr(10) || '@Media:' || chr(9) || file || ', audio' AS head FROM i GROUP BY file),
  b AS (SELECT v.file, string_agg('*' || left(speaker, 4) || ':' || chr(9) || bare || ' ' || sign || ' ' || chr(21) || CAST(round(start * 1000) AS BIGINT) || '_' || CAST(round("end" * 1000) AS BIGINT) || chr(21), chr(10) ORDER BY start, utterance) AS body FROM v GROUP BY v.file)
  SELECT file, head || chr(10) || body || chr(10) || '@End' || chr(10) AS text FROM b JOIN h USING (file)""")
def _(spark, sf):
    u = _utterances(spark, sf).withColumn("text", content.written(F.transform("elements", lambda x: content.rendered(x))))
    named = transcripts.kept(_parsed(spark, sf)).where("speaker is not null")
    return content.emitted(u, lines.speaker_ids(named), "eng", "corpus")


# --- tiers


def _tiers(spark, sf):
    return transcripts.tiers(rendered.tier_lines(spark, sf))


@query("src17_src23_src26_tiers", f"WITH {TIERS_SQL} SELECT file, line, kind, name, bare || CASE WHEN start_ms IS NULL THEN '' ELSE ' ' || chr(21) || start_ms || '_' || end_ms || chr(21) END AS text, start_ms, end_ms, id % 6 = 0 AND line > 1 AS overlaps FROM p")
def _(spark, sf):
    return _tiers(spark, sf)


@query("flt05_stripped", f"WITH {TIERS_SQL} SELECT file, line, kind, name, bare AS text, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, id % 6 = 0 AND line > 1 AS overlaps FROM p WHERE NOT (kind = 'dependent' AND name = 'wor')")
def _(spark, sf):
    return transcripts.stripped(_tiers(spark, sf))


@query("flt07_time_range", f"""WITH {TIERS_SQL}, n AS (SELECT *, sum(CASE WHEN kind = 'main' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS utt FROM p) SELECT file, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM n WHERE utt BETWEEN 2 AND 4 AND kind <> 'header' AND start_ms IS NOT NULL GROUP BY file""")
def _(spark, sf):
    return transcripts.time_range(lines.sliced(_tiers(spark, sf), 2, 4))


@query("scf08_rebased", f"WITH {TIERS_SQL} SELECT file, line, bare || CASE WHEN start_ms IS NULL THEN '' ELSE ' ' || chr(21) || greatest(start_ms - 1700000000000, 0) || '_' || greatest(end_ms - 1700000000000, 0) || chr(21) END AS text FROM p")
def _(spark, sf):
    return _tiers(spark, sf).select("file", "line", transcripts.rebased(F.col("text"), 1_700_000_000_000).alias("text"))


@query("src27_media", f"WITH {TIERS_SQL} SELECT DISTINCT file, 'f' || file AS name, 'audio' AS type FROM p")
def _(spark, sf):
    return transcripts.media(rendered.tier_lines(spark, sf))


@query("flt04_one_speaker", f"""WITH {TIERS_SQL}, w AS (SELECT *, CASE WHEN kind <> 'header' THEN last_value(CASE WHEN kind = 'main' THEN name END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) END AS whose FROM p), a AS (SELECT DISTINCT file, name AS code FROM p WHERE kind = 'main')
  SELECT file, code, count(*) AS lines, CAST(sum(w.line) AS BIGINT) AS places FROM w JOIN a USING (file) WHERE kind = 'header' OR whose = code GROUP BY ALL""")
def _(spark, sf):
    raw = rendered.tier_lines(spark, sf)
    t = _tiers(spark, sf)
    who = t.where("kind = 'main'").select("file", F.col("name").alias("code")).distinct()
    return transcripts.one_speaker(t.join(raw, ["file", "line"]), who).groupBy("file", "code").agg(F.count("*").alias("lines"), F.sum("line").alias("places"))


@query("exp13_snk04_coverage_table", f"""WITH {TIMED_SQL}, c AS (SELECT file, coalesce(speaker, 'ALL') AS speaker, count(*) AS total, count(start_ms) AS timed FROM e GROUP BY GROUPING SETS ((file, speaker), (file)))
  SELECT CAST(file AS VARCHAR) AS file, speaker, total, timed, total - timed AS untimed, round(100.0 * timed / total, 1) AS coverage FROM c""")
def _(spark, sf):
    return timing.coverage_table(tables.timed(spark, sf))


@query("exp12_strategies", f"""WITH {TIMED_SQL} SELECT file, count_if(a IS DISTINCT FROM b) AS differ, count_if(a IS DISTINCT FROM b AND o) AS differ_on_overlaps FROM (SELECT file, start_ms AS a, CASE WHEN id % 5 <> 0 THEN start_ms END AS b, id % 3 = 0 AS o FROM e) GROUP BY file""")
def _(spark, sf):
    e = tables.timed(spark, sf).withColumn("overlaps", F.col("id") % 3 == 0)
    return timing.strategies(e, e.withColumn("start_ms", F.when(F.col("id") % 5 != 0, F.col("start_ms"))).withColumn("overlaps", ~F.col("overlaps")))


# --- brackets and alignment


@query("scf01_brackets", f"""WITH {TIMED_SQL}, t AS (SELECT file, idx AS line, len(speaker) AS n FROM e)
  SELECT file, line, CAST(unnest([0, n + 1, n + 13, n + 16, n + 22, n + 24]) AS INT) AS char_offset, unnest(['Open', 'Close', 'Open', 'CloseForced', 'Open', 'Close']) AS kind, CAST(unnest([NULL, NULL, 2, 2, NULL, NULL]) AS INT) AS "index" FROM t""")
def _(spark, sf):
    text = F.concat(F.lit("["), F.col("speaker"), F.lit("] ((c [y])) [2z2$] <<[q]>> ((open [x]"))
    t = transcripts.once(tables.timed(spark, sf).select("file", F.col("idx").alias("line"), "speaker"), brackets.tokens(text).alias("b"))
    return t.select("file", "line", F.explode("b").alias("b")).select("file", "line", "b.*")


@query("scf11_scf09_similarity", f"""WITH {TIMED_SQL}, t AS (SELECT file, idx, 'the ' || speaker || CASE WHEN id % 2 = 0 THEN ' page' ELSE '' END AS a, CASE WHEN id % 5 = 0 THEN '' WHEN id % 7 = 0 THEN speaker ELSE 'the ' || lead(speaker) OVER (PARTITION BY file ORDER BY idx) || ' page' END AS b FROM e),
  w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM t WHERE b IS NOT NULL)
  SELECT file, idx, CAST(CASE WHEN a = b AND a <> '' THEN 100 WHEN a = '' AND b = '' THEN 10 WHEN a = '' OR b = '' THEN 0 WHEN contains(a, b) OR contains(b, a) THEN 80 ELSE len(list_intersect(x, y)) * 60 // greatest(len(x), len(y)) END AS INT) AS score FROM w""")
def _(spark, sf):
    i = F.col("id")
    t = tables.timed(spark, sf).withColumns({"a": F.concat(F.lit("the "), F.col("speaker"), F.when(i % 2 == 0, " page").otherwise("")), "next": F.lead("speaker").over(timing.by_file())})
    b = F.when(i % 5 == 0, "").when(i % 7 == 0, F.col("speaker")).otherwise(F.concat(F.lit("the "), F.col("next"), F.lit(" page")))
    return t.withColumn("b", b).where("b is not null").select("file", "idx", align.similarity_of(F.col("a"), F.col("b")).alias("score"))


@query("scf28_alike", "SELECT a.p_partkey, a.p_name, jaro_winkler_similarity(a.p_name, b.p_name) >= 0.85 AS alike FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, sf):
    p = tables.read(spark, sf, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", "p_name", (align.alike(F.col("p_name"), F.col("other")) >= 0.85).alias("alike"))


@query("scf10_marked_text", f"""WITH {TIMED_SQL} SELECT file, idx, speaker || ' one' AS top, CASE WHEN id % 2 = 0 THEN 'two ' || id ELSE 'two ' || id || ' rest' END AS bottom FROM e""")
def _(spark, sf):
    text = F.concat(F.lit("*A:\tso ⌈2"), F.initcap("speaker"), F.lit(" &=in One⌉ and ⌊ Two, "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "⌋").otherwise(""), F.lit(" rest"))
    t = tables.timed(spark, sf).withColumn("text", text)
    return t.select("file", "idx", brackets.marked_text(F.col("text"), "⌈").alias("top"), brackets.marked_text(F.col("text"), "⌊").alias("bottom"))


@query("jon12_names", "SELECT id, min(name) AS name FROM (SELECT DISTINCT p_brand AS name, right(p_brand, 2) AS id FROM part) GROUP BY id")
def _(spark, sf):
    p = tables.read(spark, sf, "part").select(F.col("p_brand").alias("name"), F.right("p_brand", F.lit(2)).alias("id")).distinct()
    return lines.names_by_id(p)


# --- annotations


_MARKS = ["[/]", "[//]", "[!]", "[?]", "[e]", "[<2]", "[=! laughs]", "[* m]", "[odd]"]
_CLASSES = ["RETRACE_PARTIAL", "RETRACE_FULL", "STRESSING", "UNCERTAIN", "EXCLUDE", "OVERLAP_BEGIN", "PARALINGUISTIC", "ERROR", "UNKNOWN([odd])"]


@query("scf13_win09_runs", f"""WITH {TIMED_SQL}, m AS (SELECT file, idx, {_CLASSES}[id % 9 + 1] AS a, {_CLASSES}[id // 9 % 9 + 1] AS b FROM e) SELECT file, idx, a || ' ' || b AS run FROM m""".replace('"', "'"))
def _(spark, sf):
    at = lambda i: F.get(F.array(*map(F.lit, _MARKS)), i.cast("int"))
    i = F.col("id")
    text = F.concat(F.lit("a "), at(i % 9), F.lit(" "), at(F.floor(i / 9) % 9), F.lit(" b [/]  [//] c "), at(i % 9))
    r = tables.timed(spark, sf).select("file", "idx", F.explode(annotations.runs(text)).alias("run"))
    return r.select("file", "idx", F.array_join(F.transform("run", annotations.classify), " ").alias("run"))


# --- metadata


def _records(spark, sf):
    p = tables.read(spark, sf, "part")
    k = F.col("p_partkey")
    line = lambda key, value: F.concat(F.lit(f"{key}:\t"), value)
    rows = F.array(
        F.when(k % 5 != 0, line("Title", F.col("p_name"))), line("Title", F.lit("later")), F.when(k % 7 != 0, line("Creator", F.col("p_brand"))), line("Creator", F.lit("Doe, J")), F.lit("no key"), line("Date", F.concat((k % 30 + 1990).cast("string"), F.lit("-01-02"))), F.when(k % 3 == 0, line("Language", F.lit("eng"))),
        line("DOI", F.concat(F.lit("doi:10.1/a"), k.cast("string"))), line("DOI", F.concat(F.lit("doi:10.2/b"), k.cast("string"))), line("IMDI_" + "x" * 1200, F.lit("v")), line("Empty", F.lit("")),
    )
    path = F.concat(F.lit("repo/"), (k % 4).cast("string"), F.lit("/c/0metadata.cdc"))
    return p.select(F.concat(path, F.lit("#"), k.cast("string")).alias("file"), F.posexplode(F.array_compact(rows)).alias("line", "text"))


_REC_SQL = """m AS (SELECT p_partkey AS k, 'repo/' || (p_partkey % 4) || '/c/0metadata.cdc#' || p_partkey AS file, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE 'later' END AS title, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || '; Doe, J' ELSE 'Doe, J' END AS creators,
  (p_partkey % 30 + 1990) AS y, CASE WHEN p_partkey % 3 = 0 THEN 'eng' END AS language, '10.2/b' || p_partkey AS doi FROM part)"""


@query("src13_scf18_records", f"WITH {_REC_SQL} SELECT file, title, creators, CAST(y AS INT) AS year, language, doi, repeat('x', 1200) AS imdi FROM m")
def _(spark, sf):
    r = metadata.record(_records(spark, sf))
    return r.select("file", "title", F.array_join("creators", "; ").alias("creators"), metadata.year(F.col("date")).alias("year"), "language", "doi", F.array_join(F.transform("imdi", lambda x: x.key), ",").alias("imdi"))


@query("flt09_flt10_problems", f"WITH {_REC_SQL} SELECT file, CAST(NULL AS VARCHAR) AS missing, CASE WHEN language IS NULL THEN 'language,' ELSE '' END || 'description,country' AS sparse FROM m")
def _(spark, sf):
    return metadata.first_problem(metadata.record(_records(spark, sf))).select("file", "missing", F.array_join("sparse", ",").alias("sparse"))


@query("scf14_identifiers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '10.' || p_size || '/' || p_brand WHEN 1 THEN '10.5/x' END AS doi FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("doi:10."), F.col("p_size").cast("string"), F.lit("/"), F.col("p_brand"))).when(k == 1, " 10.5/x ").when(k == 2, "10.x/y").otherwise("10.5/")
    return tables.read(spark, sf, "part").select("p_partkey", metadata.doi(raw).alias("doi"))


@query("scf14_forms", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'https://doi.org/10.' || s_nationkey || '/' || s_name END AS resolve_url, CASE WHEN s_suppkey % 4 > 0 THEN 'doi:10.' || s_nationkey || '/' || s_name END AS scheme, CASE WHEN s_suppkey % 4 > 0 THEN upper('10.' || s_nationkey || '/' || s_name) END AS key,
  CASE s_suppkey % 3 WHEN 0 THEN 'hide' END AS retire_event, s_suppkey % 3 = 1 AS can_delete, s_suppkey % 3 = 0 AS indexed FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 > 0, F.concat(F.when(k % 2 == 0, "doi:").otherwise(" DOI:"), F.lit("10."), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_name"))).otherwise(F.col("s_name"))
    state = F.when(k % 3 == 0, "findable").when(k % 3 == 1, "Draft").otherwise("registered")
    s = tables.read(spark, sf, "supplier").select("s_suppkey", metadata.doi_forms(metadata.doi(raw)).alias("f"), metadata.doi_state(state).alias("s"))
    return s.select("s_suppkey", "f.*", "s.*")


@query("src13_olac", """SELECT CAST(c_custkey AS VARCHAR) AS file, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'early' END AS olac_linguistic_field, 'dialogue' || c_nationkey AS olac_discourse_type, c_name AS olac_linguistic_type, 'eng,' || c_mktsegment AS olac_languages FROM customer""")
def _(spark, sf):
    c = tables.read(spark, sf, "customer")
    said = lambda key, value: F.concat(F.lit(f"{key}:\t"), value)
    lines = F.array(
        said("Title", F.col("c_name")), said("Subject.olac:linguistic-field", F.lit("early")), said("Subject.olac:language", F.lit("eng")), said("Type.olac:discourse-type", F.concat(F.lit("dialogue"), F.col("c_nationkey").cast("string"))),
        said("Subject.olac:discourse-type", F.lit("later")), F.when(F.col("c_custkey") % 3 > 0, said("Subject.olac:linguistic-field", F.col("c_mktsegment"))).otherwise(F.lit("Subject.olac:linguistic-field:\t")), said("Type.olac:linguistic-type", F.lit("x")),
        said("Type.olac:linguistic-type", F.col("c_name")), said("Subject.olac:language", F.col("c_mktsegment")),
    )
    r = metadata.record(c.select(F.col("c_custkey").cast("string").alias("file"), F.posexplode(lines).alias("line", "text")))
    return r.select("file", "olac_linguistic_field", "olac_discourse_type", "olac_linguistic_type", F.array_join("olac_languages", ",").alias("olac_languages"))


@query("scf15_payload", f"""WITH {_REC_SQL} SELECT file, '10.2/b' || k AS doi, title, CAST(y AS BIGINT) AS year FROM m""")
def _(spark, sf):
    r = metadata.payload(metadata.record(_records(spark, sf)))
    at = lambda path: F.get_json_object("payload", f"$.data.attributes.{path}")
    return r.select("file", at("doi").alias("doi"), at("titles[0].title").alias("title"), at("publicationYear").cast("long").alias("year"))


@query("snk07_scf17_export", f"WITH {_REC_SQL} SELECT doi, 'https://repo.example.org/access/' || (k % 4) || '/c.html' AS target, title, creators, 'Example Press' AS publisher, CAST(y AS VARCHAR) AS year, coalesce(language, '') AS language, '' AS description, '' AS country FROM m")
def _(spark, sf):
    return metadata.exported(metadata.record(_records(spark, sf)), "example.org", "example", "Example Press")


@query("snk09_rewritten", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A:' || chr(9) || p_name || chr(10) || 'DOI:' || chr(9) || 'doi:10.9/n' || chr(10) || 'DOI:' || chr(9) || 'doi:10.9/n' ELSE 'A:' || chr(9) || p_name || chr(10) || 'DOI:' || chr(9) || 'doi:10.9/n' || chr(10) END AS text FROM part")
def _(spark, sf):
    text = F.concat(F.lit("A:\t"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "\nDOI:\told\nDOI: x\n").otherwise("\n\n "))
    return tables.read(spark, sf, "part").select("p_partkey", metadata.with_doi(text, F.lit("10.9/n")).alias("text"))


@query("scf19_paths", "SELECT p_partkey, 'c' || (p_partkey % 3) AS collection, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'f.cha' WHEN 2 THEN 'a' ELSE 'a/b' END AS corpus FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.lit("c"), (k % 3).cast("string"), F.get(F.array(*map(F.lit, ("", "/f.cha", "/a/f.cha", "/a/b/f.cha"))), (k % 4).cast("int")))
    return tables.read(spark, sf, "part").select("p_partkey", transcripts.collection(path).alias("collection"), transcripts.corpus_path(path).alias("corpus"))


@query("src04_files", "SELECT p_partkey, 'x/' || p_brand || '/f.cha' AS path FROM part WHERE p_partkey % 3 > 0")
def _(spark, sf):
    path = F.concat(F.lit("x/"), F.when(F.col("p_partkey") % 3 == 0, "0phonbank").otherwise(F.col("p_brand")), F.lit("/f.cha"))
    return transcripts.corpora(tables.read(spark, sf, "part").select("p_partkey", path.alias("path")))


@query("src24_path_list", "SELECT 'd/' || p_brand AS path FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("  d/"), F.col("p_brand"), F.lit(" "))).when(k % 3 == 1, "# note").otherwise("   ")
    return transcripts.path_list(tables.read(spark, sf, "part").select(raw.alias("raw")))


@query("src25_asr_tokens", "SELECT event_id AS file, CAST(unnest([0, 1]) AS INT) AS nth, unnest([event_type, 'b']) AS text, CAST(unnest([1, 3]) AS BIGINT) AS start_ms, CAST(unnest([2, event_id]) AS BIGINT) AS end_ms FROM events WHERE event_id % 4 > 0")
def _(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "{broken").otherwise(F.concat(F.lit('[{"text":"'), F.col("event_type"), F.lit('","start_ms":1,"end_ms":2},{"text":"b","start_ms":3,"end_ms":'), i.cast("string"), F.lit("}]")))
    return transcripts.asr_tokens(tables.read(spark, sf, "events").select(i.alias("file"), raw.alias("raw"))).where("text is not null")


@query("src20_exp10_warnings", f"""WITH {TIMED_SQL}, w AS (SELECT file, idx, CASE WHEN idx % 10 = 1 THEN '/p/' || idx END AS path, CASE id % 4 WHEN 0 THEN 'E722' WHEN 1 THEN 'E723' WHEN 2 THEN 'E722' END AS code FROM e),
  c AS (SELECT file, last_value(path IGNORE NULLS) OVER (PARTITION BY file ORDER BY idx ROWS UNBOUNDED PRECEDING) AS path, code FROM w) SELECT path, code, count(*) AS n, count(DISTINCT file) AS logs FROM c WHERE code IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    i = F.col("id")
    code = F.get(F.array(*map(F.lit, ("warning[E722] a", "warning[E723]", "warning[E724] warning[E722]", "fine"))), (i % 4).cast("int"))
    raw = F.concat(F.when(F.col("idx") % 10 == 1, F.concat(F.lit("/p/"), F.col("idx").cast("string"), F.lit("\n"))).otherwise(""), code)
    t = tables.timed(spark, sf).select("file", F.explode(F.split(raw, "\n")).alias("raw"), (F.col("idx") * 2).alias("at"))
    log = t.withColumn("line", F.col("at") + (~F.col("raw").startswith("/")).cast("int"))
    found = transcripts.warning_log(log, ["E722", "E723", "E724"])
    return found.groupBy("path", "code").agg(F.count("*").alias("n"), F.countDistinct("file").alias("logs"))


_DUMMY = ["@Options:\tdummy", "this file only permits playback"]


@query("flt08_dummies", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    text = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("@Begin\n"), F.lit(_DUMMY[0]))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(_DUMMY[1]), F.lit("."))).otherwise(F.col("text"))
    return tables.read(spark, sf, "documents").withColumn("text", text).where(transcripts.is_dummy(F.col("text"), *_DUMMY)).select("doc_id")


@query("flt17_scf23_options", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'already' WHEN 1 THEN 'updated' WHEN 2 THEN 'created' END AS status, CASE doc_id % 4 WHEN 0 THEN '@Begin|@Options:' || chr(9) || 'CA, NoAlign|@ID:x' WHEN 1 THEN '@Begin|@Options:' || chr(9) || 'NoAlignment, NoAlign|@ID:x' WHEN 2 THEN '@Begin|@Options:' || chr(9) || 'NoAlign|@ID:x|@ID:y' ELSE '@Begin' END AS text FROM documents""")
def _(spark, sf):
    raw = F.get(F.array(*map(F.lit, ("@Begin\n@Options:\tCA, NoAlign\n@ID:x", "@Begin\n@Options:\tNoAlignment\n@ID:x", "@Begin\n@ID:x\n@ID:y", "@Begin"))), (F.col("doc_id") % 4).cast("int"))
    d = tables.read(spark, sf, "documents").select("doc_id", transcripts.with_option(F.split(raw, "\n")).alias("o"))
    return d.select("doc_id", F.col("o.status").alias("status"), F.array_join("o.lines", "|").alias("text"))


@query("scf22_underlines", "SELECT doc_id, 'a' || chr(2) || chr(1) || lang || chr(2) || chr(2) || 'b' || source AS text, CAST(doc_id % 3 AS INT) AS begins, CAST(doc_id % 2 AS INT) AS ends FROM documents")
def _(spark, sf):
    b, e = map(F.lit, transcripts.UNDERLINE)
    i = F.col("doc_id").cast("int")
    text = F.concat(F.repeat(e, i % 2), F.lit("a"), F.repeat(b, i % 3), b, F.col("lang"), e, F.lit("b"), F.col("source"))
    return tables.read(spark, sf, "documents").select("doc_id", transcripts.underlined(text).alias("u")).select("doc_id", "u.*")


@query("exp08_delta", f"""WITH {TIMED_SQL} SELECT file, idx, CASE WHEN id % 4 = 0 THEN '-' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN id % 2 = 1 THEN '%mor' END, CASE WHEN id % 3 = 1 THEN 'timing' END], lambda x: x IS NOT NULL), ', '), ''), '-') END AS added, CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END AS INT) AS out_lines FROM e""")
def _(spark, sf):
    i = F.col("id")
    t = tables.timed(spark, sf).select("file", "idx", F.when(i % 2 == 0, "*A:\tx\n%mor:\ty").otherwise("*A:\tx").alias("before"), F.when(i % 4 != 0, F.concat(F.lit("*A:\tx"), F.when(i % 3 == 1, "\x151_2\x15").otherwise(""), F.lit("\n%mor:\ty"))).alias("after"))
    return chat.added(t).select("file", "idx", "added", "out_lines")


@query("win04_backwards_inside", f"WITH {RAW_SQL}, p AS (SELECT file, line, who, start, lag(start) OVER (PARTITION BY file ORDER BY line) AS prev FROM r WHERE NOT bad) SELECT file, line FROM p WHERE who IS NULL AND start > 0 AND prev > 0 AND start < prev - 0.05")
def _(spark, sf):
    k = transcripts.kept(_parsed(spark, sf)).withColumn("named", F.col("speaker").isNotNull())
    return lines.backwards_inside(k).select("file", "line")


@query("srt06_first_changes", """WITH a AS (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_partkey % 60 AS k FROM lineitem WHERE l_orderkey % 3 = 0), c AS (SELECT 'added' AS change, k, count(*) AS times FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL UNION ALL SELECT 'removed', k, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL)
  SELECT change, k, times FROM c QUALIFY row_number() OVER (PARTITION BY change ORDER BY k) <= 5""")
def _(spark, sf):
    l = tables.read(spark, sf, "lineitem")  # noqa: E741
    c = sets.changes(l.where("l_orderkey % 2 = 0").select((F.col("l_partkey") % 50).alias("k")), l.where("l_orderkey % 3 = 0").select((F.col("l_partkey") % 60).alias("k")))
    return sets.top(c, 5, "k", by=["change"]).select("change", "k", "times")


@query("srt07_examples", f"""WITH {TIMED_SQL}, x AS (SELECT CASE WHEN id % 5 = 0 THEN 'fifth' WHEN id % 3 = 0 THEN 'third' END AS label, id FROM e) SELECT label, id FROM x WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 4""")
def _(spark, sf):
    i = F.col("id")
    return sets.examples(tables.timed(spark, sf), [("fifth", i % 5 == 0), ("third", i % 3 == 0)], 4, "id").select("label", "id")
