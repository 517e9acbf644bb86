"""Transcript files as rows: line layouts, tiers, headers, bullets, logs, token lists, path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Windows-1252 characters 0x80 to 0x9F, as ISO-8859-1 reads them and as they are meant.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
SPEAKER = r"^[>#*]*(?:[A-Z][A-Za-z0-9_?/]*|[a-z].+)$"
#: A number with at most one point, perhaps with colons after it.
STAMP = r"(?=.)\d*\.?\d*:*"


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """SRC-01, 02, 12: (path, content, length, modificationTime) of the files that fit ``glob`` (cases as given)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def decoded(content: Column) -> Column:
    """SRC-05: bytes as Windows-1252 text; NUL is read as c, a right quote as ', DEL and CR are dropped."""
    return F.translate(F.translate(F.decode(content, "ISO-8859-1"), _C1, _1252), "\x00’\x7f\r", "c'")


def numbered(rows: DataFrame, text: str = "text") -> DataFrame:
    """Lines of each text, from 1, blank ones dropped (FLT-01)."""
    lines = rows.select("file", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    return lines.select("file", (F.col("line") + 1).alias("line"), "raw").where(F.trim("raw") != "")


def layout_of(raw: Column) -> Column:
    """SRC-06: a file's layout by its first line. A: two times in the first of three fields; B: a time in each of the first two of
    three fields, or two fields that are both times; C: two fields, the first beginning with two times; else A."""
    fields = F.split(raw, "\t")
    f0, f1, n = F.trim(F.get(fields, F.lit(0))), F.trim(F.get(fields, F.lit(1))), F.size(fields)
    one = rf"^{STAMP[:-2]}\s*:*$"
    both = f0.rlike(one) & f1.rlike(one)
    a, c = f0.rlike(rf"^{STAMP}\s*[ ]\s*{STAMP}$"), f0.rlike(rf"^{STAMP}\s*[ ]\s*{STAMP}(?:\s|$)")
    return F.coalesce(F.when(n >= 3, F.when(a, "A").when(both, "B")).when(n == 2, F.when(c, "C").when(both, "B")), F.lit("A"))


def layouts(lines: DataFrame) -> DataFrame:
    """SRC-06: (file, layout) of each file, see :func:`layout_of`."""
    first = lines.groupBy("file").agg(F.min_by("raw", "line").alias("raw"))
    return first.select("file", layout_of(F.col("raw")).alias("layout"))


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """The rows with ``columns`` added, each worked out once a row: a filter on a column of a projection is moved below it, with all
    that the column takes, which then is done again above; it is not moved below an explode."""
    return rows.select("*", F.explode(F.array(F.struct(*columns))).alias("once")).select(*rows.columns, "once.*")


def stamp(text: Column) -> Column:
    """SRC-11: a time, colons after it left out."""
    return F.trim(F.regexp_replace(F.trim(text), ":+$", "")).try_cast("double")


def speaker_of(field: Column) -> Column:
    """FLT-03: the name in a speaker field, or null if it isn't one: after any of > # *, an upper-case letter with letters,
    digits, _ ? / after it, or a lower-case letter with anything after it."""
    name = F.regexp_replace(F.trim(field), ":+$", "")
    return F.when(name.rlike(SPEAKER), name)


def parsed(lines: DataFrame) -> DataFrame:
    """SRC-07 to SRC-11: (file, line, layout, start, end, speaker, content, problem); speaker is null on a continuation.

    A start of more than four characters that is all zeros makes both times 0; unreadable times drop the line (problem
    'bad stamp'), so do too few tabs ('broken tabs'); an end earlier than its start by over 0.01 stays with a problem. A line of
    layout A without any tab is split at blanks.
    """
    # the layout comes from the first line of a file, in the order in which the lines are read anyway
    w = Window.partitionBy("file").orderBy(F.col("line").asc_nulls_last())
    l = lines.where("file is not null").select("file", "line", "raw", F.row_number().over(w).alias("nth"))  # noqa: E741
    layout = F.first("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    l = l.withColumn("first", F.when(F.col("nth") == 1, layout_of(F.col("raw")))).select("file", "line", "raw", layout.alias("layout"))  # noqa: E741
    # two splits hold all fields: without a tab the head is the whole line
    l = l.withColumn("fields", F.split("raw", "\t", 4)).withColumn("head", F.split(F.trim(F.get("fields", F.lit(0))), r"\s+"))  # noqa: E741
    g = lambda a, i: F.get(a, F.lit(i))
    fields, head, n = F.col("fields"), F.col("head"), F.size("fields")
    is_b, is_c, no_tab = F.col("layout") == "B", F.col("layout") == "C", n < 2
    broken = ~is_b & ~is_c & no_tab
    after = lambda i: F.array_join(F.slice(fields, F.lit(i + 1), F.greatest(n - i, F.lit(0))), "\t")
    fits = F.when(is_b, n >= 3).when(is_c, ~no_tab & (F.size(head) >= 2)).otherwise(F.size(head) >= F.when(broken, 3).otherwise(2))
    third = speaker_of(g(head, 2))
    start, end = (F.when(is_b, g(fields, i)).otherwise(g(head, i)) for i in (0, 1))
    speaker = F.when(broken | is_c, third).otherwise(speaker_of(F.when(is_b, g(fields, 2)).when(n >= 3, g(fields, 1))))
    rest = F.array_join(F.slice(head, F.when(third.isNotNull(), 4).otherwise(3), F.size(head)), " ")
    content = F.when(broken, rest).when(is_b, g(fields, 3)).when(is_c, F.when(~no_tab, after(1))).otherwise(F.when(n >= 3, after(2)).otherwise(g(fields, 1)))
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), ":+$", ""))
    l = once(l, fits.alias("fits"), bare(start).alias("from"), bare(end).alias("to"), speaker.alias("speaker"), F.coalesce(content, F.lit("")).alias("content"))  # noqa: E741
    zero = F.coalesce((F.length("from") > 4) & F.col("from").rlike("^0+$"), F.lit(False))
    time = lambda c: F.col(c).try_cast("double").alias({"from": "start", "to": "end"}[c])
    out = once(l, zero.alias("zero"), time("from"), time("to"))
    at = lambda c: F.when(F.col("zero"), 0.0).otherwise(F.col(c)).alias(c)
    problem = F.when(~F.col("fits"), "broken tabs").when(F.col("start").isNull() | F.col("end").isNull(), "bad stamp").when(F.col("zero"), "zero stamp").when(F.col("end") < F.col("start") - 0.01, "end before start")
    return out.select("file", "line", "layout", "fits", "zero", at("start"), at("end"), "speaker", "content").withColumn("problem", problem).drop("zero", "fits")


def kept(rows: DataFrame) -> DataFrame:
    """The parsed lines that hold their times, with the speaker carried forward (WIN-01) and ``skip``, whether the line is an
    annotator's note (FLT-02): both times 0, the content starting with $."""
    from loomspan.operators.lines import carried

    note = (F.col("start") == 0) & (F.col("end") == 0) & F.ltrim("content").startswith("$")
    fine = rows.where(F.col("problem").isNull() | F.col("problem").isin("zero stamp", "end before start"))
    return carried(fine, "speaker", "effective").withColumn("skip", note)


def tiers(lines: DataFrame) -> DataFrame:
    """SRC-17, 23, 26 (lines only; no full parse is claimed): kind (header, main, dependent), name, text, first bullet, +<."""
    raw = F.col("raw")
    kind = F.when(raw.startswith("@"), "header").when(raw.startswith("*"), "main").when(raw.startswith("%"), "dependent")
    bullet = lambda k: F.regexp_extract(raw, "\u0015(\\d+)_(\\d+)\u0015", k).try_cast("long")
    text = F.regexp_extract(raw, r"^[@*%][^:\t]*:?\t?(.*)$", 1)
    return lines.select("file", "line", kind.alias("kind"), F.regexp_extract(raw, r"^[@*%]([^:\t]*)", 1).alias("name"), text.alias("text"), bullet(1).alias("start_ms"), bullet(2).alias("end_ms"), text.startswith("+<").alias("overlaps")).where("kind is not null")


def bullet(start: Column, end: Column) -> Column:
    """SCF-08: times as a bullet, or null."""
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("\u0015"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("\u0015")))


def rebased(text: Column, offset: int) -> Column:
    """SCF-08: every bullet in a text moved back by ``offset``, not below 0."""
    found = F.regexp_extract_all(text, F.lit("\u0015\\d+_\\d+\u0015"), F.lit(0))
    moved = F.transform(found, lambda b: bullet(*(F.greatest(F.regexp_extract(b, r"(\d+)_(\d+)", k).cast("long") - offset, F.lit(0)) for k in (1, 2))))
    return F.array_join(F.zip_with(F.split(text, "\u0015\\d+_\\d+\u0015", -1), moved, lambda gap, b: F.concat(gap, F.coalesce(b, F.lit("")))), "")


def stripped(t: DataFrame) -> DataFrame:
    """FLT-05: bullets taken out of the text, times dropped, word-timing tiers gone."""
    clean = F.trim(F.regexp_replace("text", " ?\u0015\\d+_\\d+\u0015", ""))
    return t.where("not (kind = 'dependent' and name = 'wor')").withColumns({"text": clean, "start_ms": F.lit(None).cast("long"), "end_ms": F.lit(None).cast("long")})


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """SRC-21, SCF-26: JSON lines; malformed ones are skipped."""
    return lines.select("file", "line", F.from_json("raw", schema).alias("j")).where("j is not null").select("file", "line", "j.*")


def asr_tokens(rows: DataFrame) -> DataFrame:
    """SRC-25: (file, raw) JSON arrays of recognised words as rows."""
    return rows.select("file", F.posexplode(F.from_json("raw", "array<struct<text string, start_ms long, end_ms long>>")).alias("nth", "t")).select("file", "nth", "t.*")


def subtitles(files_: DataFrame) -> DataFrame:
    """SRC-28 (SRT): (file, text) as (file, nth, start_ms, end_ms, text): blocks of a number, times and lines, which are joined."""
    stamp_ = r"(\d+):(\d+):(\d+)[,.](\d+)"
    block = files_.select("file", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("b"))
    at = lambda k: sum((F.regexp_extract("b", rf"{stamp_} *--> *{stamp_}", k + i).try_cast("long") * unit for i, unit in ((1, 3_600_000), (2, 60_000), (3, 1000), (4, 1))), F.lit(0))
    said = F.trim(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s+", " "))
    return block.select("file", F.regexp_extract("b", r"(?m)^\s*(\d+)\s*$", 1).try_cast("int").alias("nth"), at(0).alias("start_ms"), at(4).alias("end_ms"), said.alias("text")).where("start_ms is not null and end_ms is not null")


def text_grid(files_: DataFrame) -> DataFrame:
    """SRC-28 (TextGrid, long form): (file, text) as (file, tier, start_ms, end_ms, text): intervals that hold a text."""
    tier = files_.select("file", F.explode(F.slice(F.split("text", r"item \[\d+\]:"), F.lit(2), F.size(F.split("text", r"item \[\d+\]:")))).alias("t"))
    one = tier.select("file", F.regexp_extract("t", r'name = "([^"]*)"', 1).alias("tier"), F.explode(F.regexp_extract_all("t", F.lit(r'(xmin = [0-9.]+\s+xmax = [0-9.]+\s+text = "(?:[^"]|"")*")'), F.lit(1))).alias("i"))
    at = lambda name: F.round(F.regexp_extract("i", rf"{name} = ([0-9.]+)", 1).cast("double") * 1000).cast("long")
    said = F.replace(F.regexp_extract("i", r'(?s)text = "(.*)"$', 1), F.lit('""'), F.lit('"'))
    return one.select("file", "tier", at("xmin").alias("start_ms"), at("xmax").alias("end_ms"), said.alias("text")).where("trim(text) <> ''")


def path_list(lines: DataFrame) -> DataFrame:
    """SRC-24: one path a line, # comments and blanks skipped."""
    return lines.select(F.trim("raw").alias("path")).where("path <> '' and path not like '#%'")


# --- headers, marks and files


def media(lines: DataFrame) -> DataFrame:
    """SRC-27: (file, name, type) of the first @Media header before the first main tier; nothing where there is none."""
    main = F.min(F.when(F.col("raw").startswith("*"), F.col("line")))
    at = F.when(F.col("raw").startswith("@Media:"), F.struct("line", F.col("raw")))
    one = lines.groupBy("file").agg(main.alias("main"), F.min(at).alias("m")).where(F.col("m").isNotNull() & (F.col("main").isNull() | (F.col("m.line") < F.col("main"))))
    value = F.when(F.contains(F.col("m.raw"), F.lit("\t")), F.trim(F.substr(F.col("m.raw"), F.position(F.lit("\t"), F.col("m.raw")) + 1))).otherwise("")
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return one.select("file", F.get(parts, F.lit(0)).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("type"))


def has_option(options: Column, name: str = "NoAlign") -> Column:
    """FLT-17: whether a list of options with commas holds ``name`` as an item."""
    return F.array_contains(F.transform(F.split(options, ","), lambda x: F.trim(x)), name)


def with_option(lines: Column, name: str = "NoAlign") -> Column:
    """SCF-23: struct<lines, status> of a file's lines (array<string>) with an option added: to the first @Options header
    (updated), or as one before the first @ID (created); already: it is there; null status: there is no @ID to put it before."""
    header = F.filter(lines, lambda x: x.rlike("^@Options:\t"))
    first = F.get(header, F.lit(0))
    value = F.substr(first, F.lit(11))
    at = F.array_position(lines, first).cast("int")
    added = F.concat(F.lit("@Options:\t"), F.when(F.trim(value) == "", F.lit(name)).otherwise(F.concat(value, F.lit(f", {name}"))))
    place = F.array_position(lines, F.get(F.filter(lines, lambda x: x.rlike("^@ID:")), F.lit(0))).cast("int")
    put = lambda n, new, drop: F.concat(F.slice(lines, F.lit(1), n - 1), F.array(new), F.slice(lines, n + drop, F.size(lines)))
    done = lambda x, status: F.struct(x.alias("lines"), F.lit(status).alias("status"))
    return (
        F.when(F.size(header) > 0, F.when(has_option(value, name), done(lines, "already")).otherwise(done(put(at, added, 1), "updated")))
        .when(place > 0, done(put(place, F.lit(f"@Options:\t{name}"), 0), "created")).otherwise(done(lines, None))
    )


#: The marks of underlined text.
UNDERLINE = ("\x02\x01", "\x02\x02")


def underlined(text: Column) -> Column:
    """SCF-22: struct<text, begins, ends>: without the underline marks that have no partner, and how many those are. An end is
    matched by the last open begin; by depth: a begin is lost if the depth never comes back below it, an end if none is open."""
    mark = "\x02[\x01\x02]"
    marks, gaps = F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.split(text, mark, -1)
    begin = lambda m: m == UNDERLINE[0]

    def step(s, m):
        # open: places of open begins; lost: places of ends without one
        return F.struct(
            (s.n + 1).alias("n"), F.when(begin(m), F.concat(s.open, F.array(s.n))).otherwise(F.slice(s.open, F.lit(1), F.greatest(F.size(s.open) - 1, F.lit(0)))).alias("open"),
            F.when(~begin(m) & (F.size(s.open) == 0), F.concat(s.lost, F.array(s.n))).otherwise(s.lost).alias("lost"),
        )

    none = F.array().cast("array<int>")
    state = F.aggregate(marks, F.struct(F.lit(0).alias("n"), none.alias("open"), none.alias("lost")), step)

    def told(s):
        gone = F.concat(s.open, s.lost)
        put = F.transform(marks, lambda m, i: F.when(F.array_contains(gone, i), F.lit("")).otherwise(m))
        return F.struct(F.array_join(F.zip_with(gaps, put, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "").alias("text"), F.size(s.open).alias("begins"), F.size(s.lost).alias("ends"))

    return F.get(F.transform(F.array(state), told), F.lit(0))


def one_speaker(lines: DataFrame, participants: DataFrame) -> DataFrame:
    """FLT-04: (file, code, line, raw): for each participant (file, code) its file's headers and utterances with their dependent
    lines; @ID lines of others go, and @Participants names this one alone. ``lines`` are tiers with their raw line."""
    main = F.when(F.col("kind") == "main", F.col("name"))
    whose = F.last(main, ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    l = lines.withColumn("whose", F.when(F.col("kind") != "header", whose))  # noqa: E741
    j = l.join(participants, "file")
    id_of = F.get(F.split(F.regexp_extract("raw", r"^@ID:\t(.*)$", 1), r"\|"), F.lit(2))
    keep = F.when(F.col("kind") == "header", (F.col("name") != "ID") | (id_of == F.col("code"))).otherwise(F.col("whose") == F.col("code"))
    entries = F.filter(F.split(F.regexp_extract("raw", r"^@Participants:\t(.*)$", 1), ", *"), lambda x: F.substring_index(x, " ", 1) == F.col("code"))
    raw = F.when((F.col("kind") == "header") & (F.col("name") == "Participants"), F.concat(F.lit("@Participants:\t"), F.array_join(entries, ", "))).otherwise(F.col("raw"))
    return j.where(F.coalesce(keep, F.lit(False))).select("file", "code", "line", raw.alias("raw"))


def _by_line():
    return Window.partitionBy("file").orderBy("line")


def time_range(lines: DataFrame) -> DataFrame:
    """FLT-07: (file, start_ms, end_ms): the earliest start and latest end of the lines' first bullets, of files with any."""
    return lines.where("start_ms is not null").groupBy("file").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def is_dummy(text: Column, *marks: str) -> Column:
    """FLT-08: whether a file's text holds any of the strings that mark one without contents."""
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return F.coalesce(found, F.lit(False))


def large(files_: DataFrame, megabytes: int = 50) -> DataFrame:
    """FLT-12: files (path, length) of more than so many MB."""
    return files_.where(F.col("length") > megabytes * 1024 * 1024)


def unchanged_since(files_: DataFrame, cutoff: Column) -> DataFrame:
    """FLT-13: files (modificationTime) that were last changed before ``cutoff``."""
    return files_.where(F.col("modificationTime") < cutoff)


def corpora(files_: DataFrame, skipped: str = "0phon") -> DataFrame:
    """SRC-04: files (path) in no folder whose path holds ``skipped``."""
    return files_.where(~F.contains(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit(skipped)))


def warning_log(lines: DataFrame, codes: list[str]) -> DataFrame:
    """SRC-20: (file, line, path, code): the first of ``codes`` in each line's warning[...], under the last line that began with /."""
    path = F.last(F.when(F.col("raw").startswith("/"), F.trim("raw")), ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    code = F.coalesce(*(F.when(F.contains(F.col("raw"), F.lit(f"warning[{c}]")), F.lit(c)) for c in codes))
    return lines.select("file", "line", path.alias("path"), code.alias("code")).where("code is not null")


def collection(path: Column) -> Column:
    """SCF-19: the first component of a path below the data folder."""
    return F.get(F.split(path, "/"), F.lit(0))


def corpus_path(path: Column) -> Column:
    """SCF-19: the components between the first and the last; of two, the last; of one, nothing."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n >= 3, F.array_join(F.slice(parts, F.lit(2), n - 2), "/")).when(n == 2, F.get(parts, F.lit(1))).otherwise("")


def document(rows: DataFrame) -> DataFrame:
    """SNK-01, SRT-01: utterances (file, idx, speaker, text, start_ms, end_ms) as one text a file, by start (null as 0)."""
    line = F.concat(F.lit("*"), F.col("speaker"), F.lit(":\t"), F.col("text"), F.coalesce(F.concat(F.lit(" "), bullet(F.col("start_ms"), F.col("end_ms"))), F.lit("")))
    held = F.sort_array(F.collect_list(F.struct(F.coalesce("start_ms", F.lit(0)).alias("at"), "idx", line.alias("line"))))
    return rows.groupBy("file").agg(F.concat_ws("\n", F.lit("@Begin"), F.transform(held, lambda x: x.line), F.lit("@End")).alias("text"))
