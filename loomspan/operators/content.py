"""The content of transcript lines: elements, their rendering, terminators, and whole documents from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.brackets import TOKEN, shown_index

#: Stand-ins for an opening and a closing bracket, as content is read.
OPEN, CLOSE = "\x01", "\x02"

#: SCF-02: the elements in the order of their trial, as (kind, expression). A word goes on over characters that begin nothing.
ELEMENTS = [
    ("Bracket", f"[{OPEN}{CLOSE}]"), ("Space", r"[ \t]+"), ("Comment", r"\(\([^)]+\)\)"), ("NonvocalSimple", "<<[A-Z_-]+>>"), ("NonvocalBegin", "<<[A-Z_-]+"),
    ("LongFeatureBegin", "<(?!<)[A-Z0-9@%]+"), ("NonvocalEnd", "[A-Z0-9@%_-]++>>"), ("LongFeatureEnd", "[A-Z0-9@%_-]++>"), ("PauseTimed", r"\.\.\.\([0-9.]+\)"), ("PauseMedium", r"\.\.\.(?!\([0-9])"),
    ("PauseShort", r"\.\.(?!\.)"), ("Truncation", "--"), ("InhalationLengthened", r"\(H\)="), ("Inhalation", r"\(H\)"), ("Exhalation", r"\(H[xX]\)"), ("Click", r"\(TSK\)"), ("Vocalism", r"\((?!\()[^)]+\)"),
    ("Laughs", "@@+"), ("Laugh", "@(?![A-Za-z])"), ("PhonologicalFragment", "/[^/]+/"), ("Linker", "&"), ("NonvocalBeat", r"\+"), ("Glottal", "%(?![>A-Za-z])"), ("QuestionMark", r"\?"), ("Period", r"\.(?!\.)"), ("Comma", ","),
]
_WORDS = r"@[A-Za-z][A-Za-z0-9'=%-]*|[~!#][A-Za-z][A-Za-z0-9'=_-]*|[A-Za-z0-9'=%_\x{80}-\x{10ffff}-]+"
_OTHER = "|".join(p for _, p in ELEMENTS)
_REST = rf"(?:(?!{_OTHER}|{_WORDS})[\s\S])"
ELEMENT = rf"{_OTHER}|(?:{_WORDS}|{_REST}){_REST}*"
#: Of an element, what its first character can be; others are known by their last, >.
STARTS = {
    "Bracket": OPEN + CLOSE, "Space": " \t", "Comment": "(", "NonvocalSimple": "<", "NonvocalBegin": "<", "LongFeatureBegin": "<", "PauseTimed": ".", "PauseMedium": ".", "PauseShort": ".", "Truncation": "-", "InhalationLengthened": "(", "Inhalation": "(",
    "Exhalation": "(", "Click": "(", "Vocalism": "(", "Laughs": "@", "Laugh": "@", "PhonologicalFragment": "/", "Linker": "&", "NonvocalBeat": "+", "Glottal": "%", "QuestionMark": "?", "Period": ".", "Comma": ",",
}
#: Labels that may end right after a word, longer ones first.
LABELS = ["HUMMING", "VOX", "MRC", "SING", "FOOD", "READ", "PAR", "YWN", "SM", "HI", "WH", "FF", "PP", "BR", "L2", "F", "P", "Q", "X", "@"]
TERMINATORS = ["Period", "QuestionMark", "Truncation"]


def stand_ins(content: Column) -> Column:
    """Content with each overlap bracket (SCF-01) as one character, blanks over the rest of its length."""
    found = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))
    put = F.transform(found, lambda t: F.when(t.startswith("("), t).otherwise(F.rpad(F.when(t.startswith("["), F.lit(OPEN)).otherwise(F.lit(CLOSE)), F.length(t), " ")))
    return F.array_join(F.zip_with(F.split(content, TOKEN, -1), put, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")


def elements(content: Column) -> Column:
    """SCF-02, SCF-03: array<struct<kind, value>>: the label, word, pause, count or text of each element, blanks left out.

    Of words, = is written : and % the glottal sign; a marked word loses its ~ ! or #, and a known label with > at a word's end
    is an element of its own.
    """

    def kind(t):
        k = F.lit("Word")
        for name, pattern in reversed(ELEMENTS):
            may = F.contains(F.lit(STARTS[name]), F.substr(t, F.lit(1), F.lit(1))) if name in STARTS else t.endswith(">")
            k = F.when(may & t.rlike(f"^(?:{pattern})$"), name).otherwise(k)
        # most tokens are plain words, which need no trial
        return F.when((F.substr(t, F.lit(1), F.lit(1)) >= "A") & (F.substr(t, F.lit(1), F.lit(1)) <= "z") & ~t.endswith(">") & ~t.startswith("["), "Word").otherwise(k)

    def one(name, value):
        return F.struct(F.lit(name).alias("kind") if isinstance(name, str) else name.alias("kind"), value.alias("value"))

    def valued(t, k):
        inner = lambda n: F.substr(t, F.lit(n + 1), F.length(t) - 2 * n)
        return (
            F.when(k == "Laughs", F.length(t).cast("string")).when(k == "Bracket", F.when(t == OPEN, "[").otherwise("]"))
            .when(k.isin("LongFeatureBegin", "LongFeatureEnd", "NonvocalBegin", "NonvocalEnd", "NonvocalSimple"), F.translate(t, "<>", ""))
            .when(k == "Comment", inner(2)).when(k.isin("Vocalism", "PhonologicalFragment"), inner(1)).when(k == "PauseTimed", F.regexp_extract(t, "([0-9.]+)[)]", 1)).otherwise(F.lit(""))
        )

    def word(t):
        return F.when(t.rlike("^[A-Za-z0-9']+$"), F.array(one("Word", t))).otherwise(marked_word(t))

    def marked_word(t):
        bare = F.when(t.rlike("^[~!#][A-Za-z]"), F.substr(t, F.lit(2))).otherwise(t)
        spelled = F.replace(F.replace(bare, F.lit("="), F.lit(":")), F.lit("%"), F.lit("ʔ"))
        tail = F.regexp_extract(spelled, f"({'|'.join(LABELS)})>$", 1)
        # the first of the labels that fits is the longest one
        best = F.get(F.filter(F.array(*map(F.lit, LABELS)), lambda x: spelled.endswith(F.concat(x, F.lit(">")))), F.lit(0))
        stem = F.substr(spelled, F.lit(1), F.length(spelled) - F.length(best) - 1)
        return F.when(tail == "", F.array(one("Word", spelled))).when(stem == "", F.array(one("LongFeatureEnd", best))).otherwise(F.array(one("Word", stem), one("LongFeatureEnd", best)))

    def of(t):
        return F.get(F.transform(F.array(kind(t)), lambda k: F.when(k == "Word", word(t)).otherwise(F.array(one(k, valued(t, k))))), F.lit(0))

    found = F.regexp_extract_all(stand_ins(content), F.lit(ELEMENT), F.lit(0))
    return F.flatten(F.transform(F.filter(found, lambda t: ~t.startswith(" ") & ~t.startswith("\t")), of))


def is_content(e: Column) -> Column:
    """Whether an element is content; terminators and the linker are not."""
    return ~e.kind.isin(*TERMINATORS, "Linker")


#: SCF-05, fixed values: elements that are always written alike.
WRITTEN = {"PauseShort": "(..)", "PauseMedium": "(...)", "Inhalation": "&=in", "InhalationLengthened": "&=in &=lengthened", "Exhalation": "&=ex", "Click": "&=tsk", "Laugh": "&=laugh", "NonvocalBeat": "&=nonvocal", "Glottal": "ʔuh", "Comma": ","}
MARKS = {"top": ("⌈", "⌉"), "bottom": ("⌊", "⌋")}


def rendered(e: Column, bracket: Column | None = None) -> Column:
    """SCF-05: how one element of content is written. bracket: what stands for a bracket (default: one without a role)."""
    v, k = e.value, e.kind
    name = F.lower(F.replace(F.replace(v, F.lit(","), F.lit("_AND")), F.lit("."), F.lit("_POINT_")))
    sound = F.when(v.rlike("^%H[xX]$"), F.lit("ʔuh &=ex")).when(v.startswith("%"), F.concat(F.lit("ʔuh &="), F.lower(F.substr(v, F.lit(2))))).otherwise(F.concat(F.lit("&="), name))
    out = F.element_at(F.create_map(*(F.lit(x) for kv in WRITTEN.items() for x in kv)), k)
    return (
        F.when(k == "Word", F.when(v.startswith("@"), F.concat(F.substr(v, F.lit(2)), F.lit(" [% laugh]"))).otherwise(v))
        .when(k == "Bracket", F.coalesce(bracket, F.lit("⌈?")) if bracket is not None else F.lit("⌈?")).when(k == "PauseTimed", F.concat(F.lit("("), v, F.lit(")")))
        .when(k.isin("Vocalism", "Comment"), sound).when(k == "Laughs", F.array_join(F.array_repeat(F.lit("&=laugh"), v.try_cast("int")), " "))
        .when(k == "LongFeatureBegin", F.concat(F.lit("&{l="), v)).when(k == "LongFeatureEnd", F.concat(F.lit("&}l="), v)).when(k == "NonvocalBegin", F.concat(F.lit("&{n="), v))
        .when(k == "NonvocalEnd", F.concat(F.lit("&}n="), v)).when(k == "NonvocalSimple", F.concat(F.lit("&={n="), v, F.lit("}"))).when(k == "PhonologicalFragment", F.concat(F.lit("/"), v, F.lit("/"))).otherwise(out)
    )


def written(parts: Column) -> Column:
    """SCF-05: rendered elements as one text, a blank before each but the first and commas."""
    spaced = F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.when((p == ",") | (i == 0), p).otherwise(F.concat(F.lit(" "), p)))
    return F.array_join(spaced, "")


def terminator(last: Column, gap: Column) -> Column:
    """SCF-06: what a terminator (a kind, or null) is written as; a truncation is an interruption if the next line starts
    before this one ends (gap below 0), else a trailing off."""
    return F.when(last == "QuestionMark", "?").when(last == "Truncation", F.when(gap < 0, "+/.").otherwise("+...")).when(last == "Linker", "+,").otherwise(".")


def marker(role: Column, is_open: Column, real_index: Column) -> Column:
    """A bracket with a role as its overlap mark, with its shown index (SCF-24)."""
    begin = F.when(role == "top", MARKS["top"][0]).when(role == "bottom", MARKS["bottom"][0])
    end = F.when(role == "top", MARKS["top"][1]).when(role == "bottom", MARKS["bottom"][1])
    return F.concat(F.when(is_open, begin).otherwise(end), F.coalesce(shown_index(real_index).cast("string"), F.lit("")))


def milliseconds(seconds: Column) -> Column:
    """SCF-07: seconds as whole milliseconds, halves away from 0."""
    return F.round(seconds * 1000).cast("long")


def utterances(lines: DataFrame) -> DataFrame:
    """(file, utterance, speaker, first_line, last_line, start_ms, end_ms, elements, mark): the lines of each utterance (WIN-03)
    put together. ``lines``: file, line, speaker, start, end, skip, content.

    mark is the terminator as it is written: of the last terminator; without one, a comma at the end is taken off for a period.
    """
    from loomspan.operators.lines import by_file, labelled

    e = lines.withColumn("elements", elements(F.col("content")))
    e = e.withColumns({"ends": F.exists("elements", lambda x: x.kind.isin(*TERMINATORS)), "n": F.size(F.filter("elements", is_content))})
    held = F.sort_array(F.collect_list(F.struct("line", "elements")))
    whole = F.flatten(F.transform(held, lambda x: x.elements))
    placed = labelled(e).withColumn("next_start", F.lead("start").over(by_file()))
    u = placed.groupBy("file", "turn", "part").agg(
        F.min_by("who", "line").alias("speaker"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by("start", "line").alias("start"), F.max_by("end", "line").alias("end"), F.max_by("next_start", "line").alias("next_start"),
        whole.alias("all"), F.sum("n").alias("n"),
    ).where("n > 0")
    u = u.withColumn("utterance", F.row_number().over(Window.partitionBy("file").orderBy("first_line")).cast("long"))
    last = F.element_at(F.filter("all", lambda x: ~is_content(x)), -1).kind
    u = u.withColumns({"last": F.when(F.exists("all", lambda x: ~is_content(x)), last), "content": F.filter("all", is_content)})
    comma = F.col("last").isNull() & (F.element_at("content", -1).kind == "Comma")
    mark = terminator(F.col("last"), F.coalesce(F.col("next_start") - F.col("end"), F.lit(1.0)))
    fewer = F.when(comma, F.slice("content", F.lit(1), F.size("content") - 1)).otherwise(F.col("content"))
    return u.select("file", "utterance", "speaker", "first_line", "last_line", milliseconds(F.col("start")).alias("start_ms"), milliseconds(F.col("end")).alias("end_ms"), fewer.alias("elements"), mark.alias("mark"))


def emitted(u: DataFrame, ids: DataFrame, language: str, corpus: str) -> DataFrame:
    """SNK-01: (file, text): a document of each file's utterances (file, utterance, speaker, start_ms, end_ms, text, mark), by
    start (null as 0), ties as they come. ids: (file, speaker, id). A speaker with > before the name is the environment."""
    role = F.when(F.col("speaker").startswith(">"), "Environment").otherwise("Speaker")
    people = ids.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("speaker", "id", role.alias("role")))).alias("people"))
    named = u.join(ids, ["file", "speaker"], "left")
    head = F.when(F.col("speaker").startswith(">"), F.lit("%com:\t")).otherwise(F.concat(F.lit("*"), F.coalesce("id", "speaker"), F.lit(":\t")))
    bullet = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.concat(F.lit(" \x15"), F.col("start_ms").cast("string"), F.lit("_"), F.col("end_ms").cast("string"), F.lit("\x15")))
    line = F.concat(head, F.col("text"), F.lit(" "), F.col("mark"), F.coalesce(bullet, F.lit("")))
    body = named.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("start_ms", F.lit(0)).alias("at"), "utterance", line.alias("line")))).alias("body"))
    d = body.join(people, "file", "left").withColumn("people", F.coalesce("people", F.array().cast("array<struct<speaker:string,id:string,role:string>>")))
    headers = F.array(F.lit("@UTF8"), F.lit("@Begin"), F.lit(f"@Languages:\t{language}"), F.concat(F.lit("@Participants:\t"), F.array_join(F.transform("people", lambda p: F.concat_ws(" ", p.id, p.role)), ", ")), F.lit("@Options:\tCA"))
    each = F.transform("people", lambda p: F.concat(F.lit(f"@ID:\t{language}|{corpus}|"), p.id, F.lit("|||||"), p.role, F.lit("|||")))
    text = F.array_join(F.concat(headers, each, F.array(F.concat(F.lit("@Media:\t"), F.col("file").cast("string"), F.lit(", audio"))), F.transform("body", lambda x: x.line), F.array(F.lit("@End"))), "\n")
    return d.select("file", F.concat(text, F.lit("\n")).alias("text"))
