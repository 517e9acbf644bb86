"""Queries of the validation rules, the edits, the reports and what else the other modules don't hold, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan import sinks
from loomspan.operators import align, annotations, chat, lexical, lines, metadata, sets, timing, transforms, validation
from loomspan.plans.queries import AUDIT_CSV_SQL, AUDIT_SQL, PAIR_SQL, RECONCILE_SQL, T_SQL, U_SQL, _annotations, _audited, _html, _local, _pairs, _registry
from loomspan.plans.registry import query
from loomspan.sources import annotations as annotation_files
from loomspan.sources import rendered, tables, transcripts
from loomspan.sources.rendered import RAW_SQL
from loomspan.sources.tables import TIMED_SQL

# --- validation


def _checked(spark, sf):
    e = tables.timed(spark, sf).withColumn("line", F.col("idx"))
    i = F.col("id")
    items = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: k.cast("string"))
    end = F.when(i % 31 == 0, F.col("start_ms") - 5).otherwise(F.col("end_ms"))
    graph = F.array(*(F.concat(F.lit(f"{k}|"), h, F.lit("|X")) for k, h in ((1, F.when(i % 4 == 1, "2").otherwise("0")), (2, F.when(i % 4 == 2, "0").when(i % 4 == 3, "3").otherwise("1")), (3, F.lit("2")))))
    return e.withColumns({"end_ms": end, "words": items(i % 3 + 1), "mor": F.when(i % 5 > 0, items(i % 4 + 1)), "pho": F.when(i % 6 > 0, items(i % 5 + 1)), "sin": F.when(i % 7 > 0, items(F.lit(2))), "gra": graph})


@query("e362_e701_e704_e705_e706_e714_e715_e718_e719_e722_e723_e724_report", f"""WITH {TIMED_SQL}, v AS (SELECT *, idx AS line, CASE WHEN id % 31 = 0 THEN start_ms - 5 ELSE end_ms END AS e2 FROM e), t AS (SELECT *, lag(start_ms) OVER (PARTITION BY file ORDER BY line) AS prev, max(e2) OVER (PARTITION BY file, speaker ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM v WHERE start_ms IS NOT NULL),
  c AS (SELECT file, line, unnest([CASE WHEN id % 5 > 0 AND id % 4 < id % 3 THEN 'E705' WHEN id % 5 > 0 AND id % 4 > id % 3 THEN 'E706' END, CASE WHEN id % 6 > 0 AND id % 5 < id % 3 THEN 'E714' WHEN id % 6 > 0 AND id % 5 > id % 3 THEN 'E715' END, CASE WHEN id % 7 > 0 AND 1 < id % 3 THEN 'E718' WHEN id % 7 > 0 AND 1 > id % 3 THEN 'E719' END,
    CASE WHEN id % 4 = 1 THEN 'E722' END, CASE WHEN id % 4 = 2 THEN 'E723' END, CASE WHEN id % 4 IN (1, 3) THEN 'E724' END]) AS code FROM v)
  SELECT file, line, code FROM c WHERE code IS NOT NULL UNION ALL SELECT file, line, 'E701' FROM t WHERE start_ms < prev UNION ALL SELECT file, line, 'E362' FROM t WHERE e2 < start_ms UNION ALL SELECT file, line, 'E704' FROM t WHERE start_ms < busy""")
def _(spark, sf):
    counts = [lambda r, t=t: validation.counts(r, t) for t in validation.COUNTS]
    return validation.report(_checked(spark, sf), validation.backwards, validation.self_overlap, *counts, validation.graph)


# --- edits


def _marked_lines(spark, sf):
    who = F.upper(F.left("speaker", F.lit(3)))
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("%com:\t⌈ x"))).otherwise(F.concat(F.lit("*"), who, F.lit(":\ta ⌈ b⌉ ⌈2 c⌉2 ⌊ "), F.col("id").cast("string"), F.lit("⌋")))
    return tables.timed(spark, sf).select("file", F.col("idx").alias("line"), "id", raw.alias("raw"))


_MARKS_SQL = f"""{TIMED_SQL}, l AS (SELECT file, idx AS line, id, upper(left(speaker, 3)) AS who FROM e WHERE id % 4 <> 0), m AS (SELECT file, line, id, who, unnest([8, 20]) AS ch, unnest(['⌈', '⌊']) AS mark FROM l)"""


@query("exp03_open_marks", f"WITH {_MARKS_SQL} SELECT file, line, CAST(ch AS INT) AS char, who AS speaker, mark, CAST(row_number() OVER (PARTITION BY file, who, mark ORDER BY line, ch) AS INT) AS nth FROM m")
def _(spark, sf):
    return transforms.open_marks(_marked_lines(spark, sf).drop("id"))


@query("exp02_indexed", f"""WITH {TIMED_SQL}, l AS (SELECT file, idx AS line, id, upper(left(speaker, 3)) AS who FROM e)
  SELECT file, line, CASE WHEN id % 4 = 0 THEN '%com:' || chr(9) || '⌈ x' ELSE '*' || who || ':' || chr(9) || 'a ⌈' || CASE WHEN id % 3 > 0 AND id % 9 > 0 THEN CAST(id % 9 + 1 AS VARCHAR) ELSE '' END || ' b⌉ ⌈2 c⌉2 ⌊ ' || id || '⌋' END AS raw,
  CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 3 END AS INT) AS found, CAST(CASE WHEN id % 4 <> 0 AND id % 3 > 0 THEN 1 ELSE 0 END AS INT) AS indexed, CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS INT) AS already, CAST(CASE WHEN id % 4 = 0 THEN 1 WHEN id % 3 > 0 THEN 1 ELSE 2 END AS INT) AS unmatched FROM l""")
def _(spark, sf):
    l = _marked_lines(spark, sf)  # noqa: E741
    marks = transforms.open_marks(l.drop("id")).where("mark = '⌈'").join(l.select("file", "line", "id"), ["file", "line"]).where("id % 3 > 0")
    return transforms.with_indices(l.drop("id"), marks.select("file", "line", "char", (F.col("id") % 9 + 1).alias("index")))


_TABLE = {"the": "THE", "then": "THEN", "other": "OTHER", "and": "&"}


@query("scf30_replaced", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'other', chr(1) || '3', 'g'), 'then', chr(1) || '2', 'g'), 'the', 'THE', 'g'), 'and', '&', 'g'), chr(1) || '2', 'THEN', 'g').replace(chr(1) || '3', 'OTHER') AS text FROM documents")
def _(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", transforms.replaced(F.col("text"), _TABLE).alias("text"))


@query("flt16_filtered", f"WITH {U_SQL}, {T_SQL} SELECT file, CAST(idx AS INT) AS idx, word FROM t WHERE speaker <> 'system' AND idx BETWEEN 1 AND 4 AND word NOT IN ('the', 'a') AND pos % 5 <> 3")
def _(spark, sf):
    f = transforms.Filter(not_speakers=["system"], first=1, last=4, not_words=["the", "a"], retracings=False)
    u = tables.utterances(spark, sf).withColumn("gem", F.lit("all")).where(f.rows())
    words = F.transform(lexical.words(F.col("text")), lambda w, i: F.struct(w.alias("word"), (i % 5 == 3).alias("retraced")))
    return u.select("file", F.col("idx").cast("int").alias("idx"), F.explode(f.of(words)).alias("word"))


@query("cln20_lowcase_retrace", f"WITH {TIMED_SQL} SELECT file, idx, 'I''m in USA ' || speaker AS low, 'well so ' || speaker || ' .' AS bare FROM e")
def _(spark, sf):
    low = transforms.lowered(F.concat(F.lit("I'm In USA "), F.initcap("speaker")))
    bare = transforms.without_retracings(F.concat(F.lit("well <he went> [//] so the [/] "), F.col("speaker"), F.lit(" .")))
    return tables.timed(spark, sf).select("file", "idx", low.alias("low"), bare.alias("bare"))


@query("cln20_fixbullets", f"""WITH {TIMED_SQL}, b AS (SELECT file, idx, start_ms, end_ms, max(end_ms) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
  SELECT file, idx, CASE WHEN start_ms IS NOT NULL THEN greatest(start_ms, coalesce(before, start_ms)) END AS start_ms, CASE WHEN end_ms IS NOT NULL THEN greatest(end_ms, start_ms, coalesce(before, start_ms)) END AS end_ms FROM b""")
def _(spark, sf):
    return transforms.fixed_bullets(tables.timed(spark, sf)).select("file", "idx", "start_ms", "end_ms")


@query("cln21_longtier_combtier_roles", f"""WITH {TIMED_SQL}, l AS (SELECT *, sum(CASE WHEN idx = 1 OR id % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY idx) AS n FROM e) SELECT file, CAST(min(idx) AS INT) AS line, string_agg('t' || id, ' ' ORDER BY idx) AS raw FROM l GROUP BY file, n""")
def _(spark, sf):
    raw = F.concat(F.when((F.col("idx") > 1) & (F.col("id") % 3 == 0), "\t ").otherwise(""), F.lit("t"), F.col("id").cast("string"))
    return transforms.one_line(tables.timed(spark, sf).select("file", F.col("idx").cast("int").alias("line"), raw.alias("raw")))


@query("nlp02_pieces", f"""WITH {TIMED_SQL}, w AS (SELECT file, idx AS nth, CASE WHEN id % 11 = 0 THEN speaker || '.' ELSE speaker END AS text, coalesce(lag(id % 11 = 0) OVER (PARTITION BY file ORDER BY idx), false) AS ended FROM e), s AS (SELECT *, sum(CASE WHEN ended THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY nth) AS sentence FROM w)
  SELECT file, CAST(sentence AS BIGINT) AS sentence, (row_number() OVER (PARTITION BY file, sentence ORDER BY nth) - 1) // 6 AS part, CAST(nth AS INT) AS nth, text FROM s""")
def _(spark, sf):
    text = F.concat(F.col("speaker"), F.when(F.col("id") % 11 == 0, ".").otherwise(""))
    return transforms.pieces(tables.timed(spark, sf).select("file", F.col("idx").cast("int").alias("nth"), text.alias("text")), 6)


@query("src16_scf25_xml", """SELECT doc_id AS file, 'r1' AS record, 'target' AS tier, 2 AS ortho_words, 1 AS ortho_pauses, CAST(doc_id % 4 AS INT) AS ipa_words, 1 AS ipa_pauses, lang || ' b' AS ortho_text FROM documents WHERE doc_id % 5 > 0 AND doc_id % 4 NOT IN (0, 2)""")
def _(spark, sf):
    return transforms.xml_mismatches(_xml(spark, sf))


def _xml(spark, sf):
    i = F.col("doc_id")
    pho = F.concat(F.repeat(F.lit("<pw>x</pw>"), (i % 4).cast("int")), F.lit("<silence/>"))
    text = F.concat(F.lit('<session xmlns="urn:x"><transcript><r id="r1"><orthography><u><w>'), F.col("lang"), F.lit("</w><pause/><w>b</w></u></orthography><ipaTarget><pho>"), pho, F.lit("</pho></ipaTarget><ipaActual><pho><pw>a</pw><pw>b</pw></pho></ipaActual></r><r><x/></r></transcript>"), F.when(i % 5 > 0, "</session>").otherwise(""))
    return tables.read(spark, sf, "documents").select(i.alias("file"), text.alias("text"))


@query("agg15_xml_totals", "SELECT count(*) AS mismatches, count(DISTINCT doc_id) AS files FROM documents WHERE doc_id % 5 > 0 AND doc_id % 4 NOT IN (0, 2)")
def _(spark, sf):
    return transforms.mismatch_totals(transforms.xml_mismatches(_xml(spark, sf)))


# --- reports


@query("snk02_document_json", f"""WITH {TIMED_SQL} SELECT file, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids, min(idx) = 1 AS ordered FROM e GROUP BY file""")
def _(spark, sf):
    e = tables.timed(spark, sf)
    d = sinks.document_json(e.select("file", F.col("idx").alias("utterance"), "id", "speaker"), e.groupBy("file").agg(F.count("*").alias("n")))
    back = d.select("file", F.from_json("json", "n long, utterances array<struct<utterance int, id long>>").alias("j"))
    ids = F.transform("j.utterances", lambda x: x.utterance)
    return back.select("file", "j.n", F.aggregate("j.utterances", F.lit(0).cast("long"), lambda s, x: s + x.id).alias("ids"), ((F.get(ids, F.lit(0)) == 1) & (ids == F.array_sort(ids))).alias("ordered"))


@query("snk03_diagnostics", f"WITH {RAW_SQL} SELECT file || ':' || line || ': ' || CASE WHEN bad THEN 'bad stamp' WHEN zero THEN 'zero stamp' ELSE 'end before start' END AS text FROM r WHERE bad OR zero OR back")
def _(spark, sf):
    return sinks.diagnostics(transcripts.parsed(rendered.raw_lines(spark, sf)).where("problem is not null"))


@query("snk05_audit_table", f"WITH {AUDIT_SQL} SELECT CAST(file AS VARCHAR) AS file, utterances, with_markers, top_begin AS \"⌈\", top_end AS \"⌉\", bottom_begin AS \"⌊\", bottom_end AS \"⌋\", cross_pairs, timed_pairs, temporal_ok, quality FROM a")
def _(spark, sf):
    return timing.audit_table(_audited(spark, sf))


@query("snk08_audit_csv", AUDIT_CSV_SQL)
def _(spark, sf):
    return metadata.audit_table(metadata.reconcile(_local(spark, sf), _registry(spark, sf), _html(spark, sf)))


@query("snk08_breakdown", f"""WITH s AS (SELECT status AS label, count(*) AS n FROM ({RECONCILE_SQL}) GROUP BY status) SELECT CAST(row_number() OVER (ORDER BY label) AS INT) AS place, label, n FROM s UNION ALL SELECT CAST(count(*) + 1 AS INT), 'TOTAL', CAST(sum(n) AS BIGINT) FROM s""")
def _(spark, sf):
    return metadata.audit_breakdown(metadata.reconcile(_local(spark, sf), _registry(spark, sf), _html(spark, sf)))


@query("snk12_markdown", "SELECT CAST(row_number() OVER (ORDER BY lang) + 3 AS BIGINT) AS nth, '| ' || lang || ' | ' || count(*) || ' |' AS text FROM documents GROUP BY lang UNION ALL SELECT * FROM (VALUES (CAST(0 AS BIGINT), '# Files'), (1, ''), (2, '| lang | files |'), (3, '|-|-|'))")
def _(spark, sf):
    n = tables.read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files"))
    return sinks.markdown_report(n, "Files", "lang")


@query("snk13_audit_json", "SELECT count(*) AS warnings, count(DISTINCT user_id) AS files, count(DISTINCT user_id % 3) AS collections, count(DISTINCT event_type) AS codes, CAST(count_if(user_id % 3 = 1) AS BIGINT) AS second FROM events")
def _(spark, sf):
    e = tables.read(spark, sf, "events").select((F.col("user_id") % 3).cast("string").alias("collection"), F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("code"))
    j = sinks.audit_json(e).select(F.from_json("json", "summary struct<warnings long, files long>, collections map<string,long>, files_by_warning map<string,array<string>>").alias("j"))
    return j.select("j.summary.warnings", "j.summary.files", F.size("j.collections").cast("long").alias("collections"), F.size("j.files_by_warning").cast("long").alias("codes"), F.element_at("j.collections", F.lit("1")).alias("second"))


# --- comparisons and counts


@query("agg08_errors_on_overlaps", f"""WITH {PAIR_SQL} SELECT file, count(t_start) AS truth, count(f_start) AS recovered, count_if(t_start IS NOT NULL AND f_start IS NOT NULL) AS both, count_if(t_start IS NOT NULL AND f_start IS NULL) AS regressions, count_if(t_start IS NULL AND f_start IS NOT NULL) AS new_coverage FROM c WHERE idx % 3 = 0 GROUP BY file""")
def _(spark, sf):
    return timing.comparison(_pairs(spark, sf).where("idx % 3 = 0"), "file")


@query("agg08_end_errors", f"WITH {PAIR_SQL} SELECT file, CAST(count(end_error) AS BIGINT) AS n, list_sort(list(abs(end_error)) FILTER (end_error IS NOT NULL))[count(end_error) // 2 + 1] AS median FROM c GROUP BY file HAVING count(end_error) > 0")
def _(spark, sf):
    return timing.error_stats(_pairs(spark, sf), "end_error", "file").select("file", "n", "median")


@query("agg10_predecessor", f"""WITH {PAIR_SQL}, p AS (SELECT *, last_value(t_start IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN t_start IS NOT NULL THEN t_end END IGNORE NULLS) OVER w AS pe FROM c WINDOW w AS (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT file, count_if(coalesce(t_start >= ps - 500 AND t_end <= pe + 500, false)) AS a_within, count_if(coalesce(f_start >= ps - 500 AND f_end <= pe + 500, false)) AS b_within FROM p GROUP BY file""")
def _(spark, sf):
    return timing.within_predecessor(_pairs(spark, sf))


@query("itr06_best_of_both", f"""WITH {TIMED_SQL}, n AS (SELECT file, count_if(speaker = 'click') AS ga, count_if(speaker = 'view') AS gb, count_if(id % 2 = 0) AS ta, count_if(id % 3 > 0) AS tb FROM e GROUP BY file) SELECT file, CASE WHEN gb < ga THEN 'global' WHEN gb > ga THEN 'two-pass' WHEN tb >= ta THEN 'two-pass' ELSE 'global' END AS choice FROM n""")
def _(spark, sf):
    n = tables.timed(spark, sf).groupBy("file").agg(F.count_if(F.col("speaker") == "click").alias("ga"), F.count_if(F.col("speaker") == "view").alias("gb"), F.count_if(F.col("id") % 2 == 0).alias("ta"), F.count_if(F.col("id") % 3 > 0).alias("tb"))
    return n.select("file", sets.better(F.col("ga"), F.col("gb"), F.col("ta"), F.col("tb")).alias("choice"))


@query("exp11_result_paths", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a/' || p_partkey WHEN p_partkey % 5 = 0 THEN 'b/' || p_partkey ELSE 'r' || p_partkey END AS path FROM part")
def _(spark, sf):
    k, p = F.col("p_partkey"), tables.read(spark, sf, "part").select("p_partkey")
    known = lambda c, f: p.where(c).select(F.concat(F.lit("r"), k.cast("string")).alias("name"), F.concat(F.lit(f), k.cast("string")).alias("path"))
    return sets.located(p.withColumn("name", F.concat(F.lit("r"), k.cast("string"))), known(k % 3 == 0, "a/"), known(k % 5 == 0, "b/")).select("p_partkey", "path")


@query("exp14_ghosts", "SELECT 'd' || p_partkey AS folder FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0")
def _(spark, sf):
    k, p = F.col("p_partkey"), tables.read(spark, sf, "part").select("p_partkey")
    folder = lambda c: p.where(c).select(F.concat(F.lit("d"), k.cast("string")).alias("folder"))
    return sets.ghosts(folder(k % 2 == 0), folder(k % 3 == 0), "folder")


@query("agg27_kinds", f"WITH {U_SQL}, {T_SQL} SELECT word AS text, CASE WHEN regexp_matches(word, '[0-9]') THEN 'number' ELSE 'word' END AS kind, count(*) AS n, count(DISTINCT speaker) AS parents FROM t GROUP BY ALL")
def _(spark, sf):
    t = lexical.tokens(tables.utterances(spark, sf), "speaker").withColumn("kind", F.when(F.col("word").rlike("[0-9]"), "number").otherwise("word"))
    return lexical.by_kind(t.select(F.col("word").alias("text"), "kind", F.col("speaker").alias("parent")))


@query("jon19_norms", """SELECT p_partkey, round((p_retailprice - m) / s, 6) AS z FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 10 AND 40)""")
def _(spark, sf):
    p = tables.read(spark, sf, "part")
    return lexical.against_norms(p.select("p_partkey", F.col("p_retailprice").alias("value")), p.where("p_brand = 'Brand#11' and p_size between 10 and 40").select(F.col("p_retailprice").alias("value"))).select("p_partkey", F.round("z", 6).alias("z"))


@query("set07_shared_words", f"WITH {TIMED_SQL} SELECT file, idx, CAST(len(list_intersect(list_distinct([speaker, 'x', 'x', 'a']), list_distinct([lead(speaker) OVER (PARTITION BY file ORDER BY idx), 'a', 'y']))) AS INT) AS shared FROM e")
def _(spark, sf):
    b = F.array(F.lead("speaker").over(timing.by_file()), F.lit("a"), F.lit("y"))
    return tables.timed(spark, sf).select("file", "idx", sets.shared(F.array(F.col("speaker"), F.lit("x"), F.lit("x"), F.lit("a")), b).alias("shared"))


@query("srt02_srt03_commonest", "SELECT l_partkey % 40 AS value, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, min(l_orderkey * 10 + l_linenumber), value LIMIT 15")
def _(spark, sf):
    l = tables.read(spark, sf, "lineitem")  # noqa: E741
    return sets.commonest(l.select((F.col("l_partkey") % 40).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")), "value", "at", 15)


@query("cln02_mor_mlu", f"WITH {TIMED_SQL} SELECT speaker, count(*) AS utterances, CAST(sum(id % 4) AS BIGINT) AS items, avg(id % 4) AS mlu FROM e WHERE id % 4 > 0 GROUP BY speaker")
def _(spark, sf):
    mor = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda k: F.when(k > 0, F.concat(F.lit("n|w"), k.cast("string"))).otherwise("")), " ")
    return lexical.mor_length(tables.timed(spark, sf).select("speaker", F.trim(mor).alias("mor")), "speaker")


@query("cln10_gemlist_gemfreq", f"""WITH {U_SQL}, {T_SQL}, h AS (SELECT file, idx, sum(CASE WHEN speaker = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY idx ROWS UNBOUNDED PRECEDING) AS gem FROM u) SELECT CAST(gem AS BIGINT) AS gem, word, count(*) AS n FROM t JOIN h USING (file, idx) WHERE gem > 0 GROUP BY ALL""")
def _(spark, sf):
    return lexical.frequency(chat.gems(tables.utterances(spark, sf), F.col("speaker") == "user"), "gem")


@query("cln01_documents", """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(regexp_replace(lower(text), '[()+:^↑↓]', '', 'g'), '[\\p{L}\\p{N}'']+')) AS word FROM documents) GROUP BY ALL""")
def _(spark, sf):
    return lexical.frequency(tables.read(spark, sf, "documents").select("lang", "text"), "lang")


@query("itr03_order")
def _(spark, sf):
    return annotations.ordering(annotations.bigrams(_annotations(spark, sf)))


@query("win15_chained_totals", f"""WITH {TIMED_SQL}, w AS (SELECT file, idx, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY file ORDER BY idx), end_ms, start_ms + 500) AS word_end FROM e WHERE start_ms IS NOT NULL) SELECT file, count(*) AS words, CAST(sum(word_end - start_ms) AS BIGINT) AS ms FROM w GROUP BY file""")
def _(spark, sf):
    w = timing.chained(tables.timed(spark, sf).where("start_ms is not null"))
    return w.groupBy("file").agg(F.count("*").alias("words"), F.sum(F.col("word_end") - F.col("start_ms")).alias("ms"))


@query("cln21_lines", f"WITH {TIMED_SQL} SELECT file, idx, row_number() OVER (PARTITION BY file ORDER BY idx) || ' ' || speaker AS text FROM e")
def _(spark, sf):
    return lines.with_numbers(tables.timed(spark, sf).select("file", F.col("idx").alias("line"), F.col("speaker").alias("text"))).select("file", F.col("line").alias("idx"), "text")


@query("cln15_diversity", f"""WITH {U_SQL}, {T_SQL}, f AS (SELECT speaker, word, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT speaker, n, count(*) AS words FROM f GROUP BY ALL), s AS (SELECT speaker, sum(n * words) AS total FROM c GROUP BY speaker HAVING sum(n * words) > 50),
  e AS (SELECT speaker, n, words, total, unnest(range(35, 51)) AS size FROM c JOIN s USING (speaker)), x AS (SELECT speaker, size, sum(words * (1 - list_aggregate(list_transform(range(0, size), lambda i: greatest(total - n - i, 0)::DOUBLE / (total - i)), 'product'))) / size AS x FROM e GROUP BY speaker, size)
  SELECT speaker, round(avg(size * x * x / (2 * (1 - x))), 6) AS d FROM x GROUP BY speaker""")
def _(spark, sf):
    return lexical.diversity(tables.utterances(spark, sf), "speaker").withColumn("d", F.round("d", 6))


#: The events of a file as cues: the nth starts at nth times two seconds and takes as long as its id says.
_CUES_SQL = f"{TIMED_SQL}, q AS (SELECT file, idx, id, speaker, 2000 * idx AS start_ms, 2000 * idx + 500 + id % 1000 AS end_ms FROM e)"


def _cues(spark, sf):
    return tables.timed(spark, sf).select("file", "idx", "id", "speaker", (F.col("idx") * 2000).cast("long").alias("start_ms"), (F.col("idx") * 2000 + 500 + F.col("id") % 1000).cast("long").alias("end_ms"))


@query("src28_subtitles", f"""WITH {_CUES_SQL} SELECT file, CAST(idx AS INT) AS nth, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, speaker || ' a ' || id || CASE WHEN id % 3 = 0 THEN ' b' ELSE '' END AS text FROM q""")
def _(spark, sf):
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    clock = lambda ms: F.concat(pad(F.floor(ms / 3_600_000), 2), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(","), pad(ms % 1000, 3))
    cue = F.concat(F.col("idx").cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), F.col("speaker"), F.lit(" a\n "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "\nb").otherwise(""), F.lit("\n"))
    files = _cues(spark, sf).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cues"))
    return transcripts.subtitles(files.select("file", F.concat(F.array_join(F.transform("cues", lambda c: c.cue), "\n"), F.lit("\n")).alias("text")))


@query("src28_textgrid", f"""WITH {_CUES_SQL} SELECT file, speaker AS tier, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, 'say "' || id || '"' AS text FROM q""")
def _(spark, sf):
    seconds = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
    one = F.concat(F.lit(" intervals ["), F.col("idx").cast("string"), F.lit("]:\n xmin = "), seconds(F.col("start_ms")), F.lit("\n xmax = "), seconds(F.col("end_ms")), F.lit('\n text = "say ""'), F.col("id").cast("string"), F.lit('"""\n'))
    tiers = _cues(spark, sf).groupBy("file", "speaker").agg(F.sort_array(F.collect_list(F.struct("idx", one.alias("one")))).alias("all"))
    item = F.concat(F.lit('\n class = "IntervalTier"\n name = "'), F.col("speaker"), F.lit('"\n'), F.array_join(F.transform("all", lambda x: x.one), ""))
    files = tiers.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("speaker", item.alias("item")))).alias("items"))
    return transcripts.text_grid(files.select("file", F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("item ["), (i + 1).cast("string"), F.lit("]:"), x.item)), "").alias("text")))


@query("src28_elan", f"""WITH {_CUES_SQL} SELECT file, unnest([speaker, speaker || '@words', speaker || '@pos']) AS tier, CASE WHEN speaker = 'click' THEN NULL ELSE upper(speaker) END AS speaker, unnest(['a' || idx, 'w' || idx, 'p' || idx]) AS id, CAST(unnest([0, 1, 2]) AS INT) AS depth, CAST(CASE WHEN id % 10 > 0 THEN start_ms END AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, unnest(['say <' || id || '> & go', 'go', '']) AS text FROM q""")
def _(spark, sf):
    def shown(tag, **attributes):
        return F.concat(F.lit(f"<{tag}"), *(x for k, v in attributes.items() for x in (F.lit(f' {k}="'), v, F.lit('"'))), F.lit(">"))

    n, i = F.col("idx").cast("string"), F.col("id")
    slot = lambda k, ms: F.concat(F.lit(f'<TIME_SLOT TIME_SLOT_ID="{k}'), n, F.lit('"'), F.coalesce(F.concat(F.lit(' TIME_VALUE="'), ms.cast("string"), F.lit('"')), F.lit("")), F.lit("/>"))
    slots = F.concat(slot("s", F.when(i % 10 > 0, F.col("start_ms"))), slot("e", F.col("end_ms")))
    put = lambda inner, value: F.concat(F.lit("<ANNOTATION>"), inner, F.lit("<ANNOTATION_VALUE>"), value, F.lit("</ANNOTATION_VALUE>"))
    base = F.concat(put(shown("ALIGNABLE_ANNOTATION", ANNOTATION_ID=F.concat(F.lit("a"), n), TIME_SLOT_REF1=F.concat(F.lit("s"), n), TIME_SLOT_REF2=F.concat(F.lit("e"), n)), F.concat(F.lit("say &lt;"), i.cast("string"), F.lit("&gt; &amp; go"))), F.lit("</ALIGNABLE_ANNOTATION></ANNOTATION>"))
    refers = lambda k, to, value: F.concat(put(shown("REF_ANNOTATION", ANNOTATION_ID=F.concat(F.lit(k), n), ANNOTATION_REF=F.concat(F.lit(to), n)), F.lit(value)), F.lit("</REF_ANNOTATION></ANNOTATION>"))
    e = _cues(spark, sf).select("file", "idx", "speaker", slots.alias("slots"), base.alias("base"), refers("w", "a", "go").alias("word"), refers("p", "w", "").alias("pos"))
    who = F.when(F.col("speaker") == "click", "").otherwise(F.concat(F.lit(' PARTICIPANT="'), F.upper("speaker"), F.lit('"')))
    tier = lambda suffix, c: F.concat(F.lit('<TIER TIER_ID="'), F.col("speaker"), F.lit(suffix + '"'), who, F.lit(">"), F.array_join(F.transform("all", lambda x: x[c]), ""), F.lit("</TIER>"))
    tiers = e.groupBy("file", "speaker").agg(F.sort_array(F.collect_list(F.struct("idx", "slots", "base", "word", "pos"))).alias("all"))
    tiers = tiers.select("file", "speaker", F.array_join(F.transform("all", lambda x: x.slots), "").alias("slots"), F.concat(tier("@pos", "pos"), tier("", "base"), tier("@words", "word")).alias("tiers"))
    files = tiers.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("speaker", "slots", "tiers"))).alias("all"))
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    text = F.concat(F.lit('<ANNOTATION_DOCUMENT AUTHOR=""><TIME_ORDER>'), joined("slots"), F.lit("</TIME_ORDER>"), joined("tiers"), F.lit("</ANNOTATION_DOCUMENT>"))
    return annotation_files.elan(files.select("file", text.alias("text")))
