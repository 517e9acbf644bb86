"""Validation rules of 2.15 as data: a code, what it looks at and an expression; compiled to one scan with windows over each file.

``lines`` (file, line, raw) are a file's lines. What the expressions see of a line:

kind (header, main, dependent, other), name, body; words of a main line (without marks in brackets and bullets); utterance: its number of
main lines so far; nth: how often its header has come, or its tier in its utterance; codes and ids: speakers of the file's
@Participants and @ID lines; items of a dependent tier and mor, the items of its utterance's %mor line; begun: gems that
are open before it, in all (begun) and of its label (same), and left: ends of its label from it on that have no beginning there.
A scope is line, word (one of its words) or file (its lines as a whole, reported at the last one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headers, those that come once at most, dependent tiers, ends of utterances.
HEADERS = (
    "Begin", "End", "UTF8", "Languages", "Participants", "Options", "Media", "ID", "Comment", "Date", "Situation", "Location", "Activities", "Bg", "Eg", "G", "PID", "Types", "Window", "Font", "Color words", "Number", "Recording Quality",
    "Room Layout", "Tape Location", "Time Duration", "Time Start", "Transcriber", "Transcription", "Warning", "Bck", "New Episode", "Blank", "Page", "Thumbnail", "Videos", "T", "L1 of", "Birth of", "Birthplace of",
)
ONCE = ("Begin", "End", "UTF8", "Languages", "Participants", "Options", "Media")
TIERS = ("mor", "gra", "pho", "mod", "sin", "wor", "tim", "cod", "com", "act", "add", "alt", "coh", "def", "eng", "err", "exp", "fac", "flo", "gls", "gpx", "int", "ort", "par", "sit", "spa", "umor")
ENDS = r"(\\.|\\?|!|\\+\\.\\.\\.|\\+\\.\\.\\?|\\+!\\?|\\+/\\.|\\+/\\?|\\+//\\.|\\+//\\?|\\+\"/\\.|\\+\"\\.|\\+\\.|≈|≋)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_H, _M, _D = "kind = 'header'", "kind = 'main'", "kind = 'dependent'"
_FIELD = lambda n: f"trim(get(split(body, '[|]'), {n}))"
_ID = f"{_H} AND name = 'ID'"
_COUNT = lambda text, x: f"(length({text}) - length(replace({text}, '{x}', '')))"
_LABELS = lambda mark, kind: f"regexp_extract_all(body, '&[{mark}]{kind}=(\\\\S+)', 1)"
_UNMET = lambda a, b, kind: f"size(array_except({_LABELS(a, kind)}, {_LABELS(b, kind)})) > 0"

#: (code, scope, condition)
RULES = [
    ("E501", "line", f"{_H} AND name IN {_LIST(ONCE)} AND nth > 1"),
    ("E502", "file", "NOT exists(headers, h -> h = 'End')"),
    ("E504", "file", "NOT (exists(headers, h -> h = 'Begin') AND exists(headers, h -> h = 'Languages') AND exists(headers, h -> h = 'Participants'))"),
    ("E505", "line", f"{_ID} AND size(split(body, '[|]')) <> 11"),
    ("E506", "line", f"{_H} AND name = 'Participants' AND trim(body) = ''"),
    ("E507", "line", f"{_H} AND name = 'Languages' AND trim(body) = ''"),
    ("E508", "line", f"{_H} AND name = 'Date' AND trim(body) = ''"),
    ("E509", "line", f"{_H} AND name = 'Media' AND trim(body) = ''"),
    ("E510", "line", f"{_ID} AND {_FIELD(0)} = ''"),
    ("E511", "line", f"{_ID} AND {_FIELD(2)} = ''"),
    ("E512", "line", f"{_H} AND name = 'Participants' AND trim(body) <> '' AND exists(split(body, ','), p -> trim(p) = '')"),
    ("E513", "line", f"{_H} AND name = 'Participants' AND exists(split(body, ','), p -> trim(p) <> '' AND size(split(trim(p), ' +')) = 1)"),
    ("E515", "line", f"{_ID} AND {_FIELD(7)} = ''"),
    ("E517", "line", f"{_ID} AND {_FIELD(3)} <> '' AND NOT {_FIELD(3)} RLIKE '^[0-9]+;([0-9]{{1,2}}[.]([0-9]{{1,2}})?)?$'"),
    ("E518", "line", f"{_H} AND name = 'Date' AND trim(body) <> '' AND NOT body RLIKE '^[0-9]{{2}}-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-[0-9]{{4}}$'"),
    ("E519", "line", f"{_H} AND name = 'Languages' AND trim(body) <> '' AND exists(split(body, ','), l -> NOT trim(l) RLIKE '^[a-z]{{3}}$')"),
    ("E522", "line", f"{_H} AND name = 'Participants' AND size(array_except(codes, ids)) > 0"),
    ("E523", "line", f"{_ID} AND {_FIELD(2)} <> '' AND NOT array_contains(codes, {_FIELD(2)})"),
    ("E524", "line", f"{_H} AND name = 'Birth of' AND NOT array_contains(codes, whom)"),
    ("E525", "line", f"{_H} AND name NOT IN {_LIST(HEADERS)}"),
    ("E526", "line", f"{_H} AND name = 'Bg' AND left <= 0"),
    ("E527", "line", f"{_H} AND name = 'Eg' AND same <= 0"),
    ("E529", "line", f"{_H} AND name = 'Bg' AND same > 0"),
    ("E530", "line", f"{_H} AND name = 'G' AND begun > 0"),
    ("E533", "line", f"{_H} AND name = 'Options' AND trim(body) = ''"),
    ("E304", "line", f"{_M} AND name = ''"),
    ("E307", "line", f"{_M} AND name <> '' AND NOT name RLIKE '^[A-Za-z0-9_-]{{1,7}}$'"),
    ("E308", "line", f"{_M} AND name <> '' AND NOT array_contains(codes, name)"),
    ("E323", "line", "kind = 'other' AND raw RLIKE '^[*][A-Za-z0-9_-]+[ \\\\t]'"),
    ("E305", "line", f"{_M} AND said <> '' AND NOT said RLIKE '(^| ){ENDS}$'"),
    ("E306", "line", f"{_M} AND said RLIKE '^{ENDS}?$'"),
    ("E312", "line", f"{_M} AND {_COUNT('body', '[')} > {_COUNT('body', ']')}"),
    ("E313", "line", f"{_M} AND {_COUNT('body', '(')} > {_COUNT('body', ')')}"),
    ("E315", "line", "raw RLIKE '[\\\\x00\\\\x03-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x14\\\\x16-\\\\x1F]'"),
    ("E360", "line", f"{_M} AND regexp_replace(body, '\\\\x15[0-9]+_[0-9]+\\\\x15', '') LIKE '%\x15%'"),
    ("E242", "line", f"{_M} AND {_COUNT('body', '“')} <> {_COUNT('body', '”')}"),
    ("E372", "line", f"{_M} AND body RLIKE '“[^”]*“'"),
    ("E230", "line", f"{_M} AND exists(array('°', '∆', '∇', '▔', '▁'), d -> (length(body) - length(replace(body, d, ''))) % 2 = 1)"),
    ("E356", "line", f"{_M} AND size(split(body, '\\\\x02\\\\x01')) > size(split(body, '\\\\x02\\\\x02'))"),
    ("E357", "line", f"{_M} AND size(split(body, '\\\\x02\\\\x01')) < size(split(body, '\\\\x02\\\\x02'))"),
    ("E358", "line", f"{_M} AND {_UNMET('{', '}', 'l')}"),
    ("E359", "line", f"{_M} AND {_UNMET('}', '{', 'l')}"),
    ("E367", "line", f"{_M} AND {_UNMET('{', '}', 'n')}"),
    ("E368", "line", f"{_M} AND {_UNMET('}', '{', 'n')}"),
    ("E373", "line", f"{_M} AND body RLIKE '[⌈⌉⌊⌋][01]'"),
    ("E208", "line", f"{_M} AND body RLIKE '\\\\[:: *\\\\]|\\\\[: *\\\\]'"),
    ("E387", "line", f"{_M} AND body RLIKE '&[+]\\\\S+ \\\\[:'"),
    ("E388", "line", f"{_M} AND body RLIKE '&~\\\\S+ \\\\[:'"),
    ("E389", "line", f"{_M} AND body RLIKE '&-\\\\S+ \\\\[:'"),
    ("E390", "line", f"{_M} AND body RLIKE '\\\\[::? [^\\\\]]*\\\\b0\\\\p{{L}}'"),
    ("E391", "line", f"{_M} AND body RLIKE '\\\\[::? [^\\\\]]*\\\\b(xxx|yyy|www)\\\\b'"),
    ("E220", "word", "w RLIKE '^[\\\\p{L}0-9]+$' AND w RLIKE '\\\\p{L}' AND w RLIKE '[1-9]|.0'"),
    ("E231", "word", "w RLIKE '\\\\p{L}' AND length(replace(w, '(', '')) <> length(replace(w, ')', ''))"),
    ("E232", "word", "w RLIKE '^[+]\\\\p{L}|\\\\p{L}[+]$'"),
    ("E233", "word", "w RLIKE '\\\\p{L}[+][+]+\\\\p{L}'"),
    ("E241", "word", "w IN ('xx', 'yy', 'ww', 'XXX', 'YYY', 'WWW')"),
    ("E244", "word", "w RLIKE '[ˈˌ][ˈˌ]'"),
    ("E245", "word", "w RLIKE '[ˈˌ]([^\\\\p{L}ˈˌ]|$)'"),
    ("E246", "word", "w RLIKE '^:+\\\\p{L}'"),
    ("E247", "word", "w RLIKE 'ˈ.*ˈ'"),
    ("E250", "word", "w LIKE '%ˌ%' AND NOT w LIKE '%ˈ%'"),
    ("E252", "word", "w RLIKE '^\\\\^|\\\\^$'"),
    ("E401", "line", f"{_D} AND nth > 1"),
    ("E404", "line", f"{_D} AND utterance = 0"),
    ("E601", "line", f"{_D} AND name NOT IN {_LIST(TIERS)} AND NOT name LIKE 'x%'"),
    ("W601", "line", f"{_D} AND name LIKE 'x%' AND trim(body) = ''"),
    ("E604", "line", f"{_D} AND name = 'gra' AND mor IS NULL"),
    ("E702", "line", f"{_D} AND name = 'mor' AND exists(items, x -> NOT x RLIKE '^([^|]+[|].+|[.?!,]|[+].*|„|‡)$')"),
    ("E708", "line", f"{_D} AND name = 'gra' AND exists(items, x -> NOT x RLIKE '^[0-9]+[|][0-9]+[|][A-Z0-9-]+$')"),
    ("E709", "line", f"{_D} AND name = 'gra' AND exists(transform(items, (x, i) -> try_cast(get(split(x, '[|]'), 0) AS INT) <> i + 1), x -> x)"),
    ("E713", "line", f"{_D} AND name = 'gra' AND exists(items, x -> try_cast(get(split(x, '[|]'), 1) AS INT) > size(items))"),
    ("E720", "line", f"{_D} AND name = 'gra' AND mor IS NOT NULL AND size(mor) <> size(items)"),
]


def seen(lines: DataFrame) -> DataFrame:
    """``lines`` with the columns that rules look at. All windows are within a file, so its lines are shuffled once."""
    part = lambda n: F.regexp_extract("raw", r"^[@*%]([^:\t]*):[\t ]?((?s).*)$", n)
    coded = F.col("raw").rlike(r"^[@*%][^:\t]*:") & ~F.col("raw").rlike(r"^\*[A-Za-z0-9_-]+ ")
    kind = F.when(F.col("raw").startswith("@"), "header").when(coded & F.col("raw").startswith("*"), "main").when(coded & F.col("raw").startswith("%"), "dependent").otherwise("other")
    plain = F.regexp_extract("raw", r"^@(\S.*?)\s*$", 1)
    r = lines.select("file", "line", "raw", kind.alias("kind"), F.when((kind == "header") & ~coded, plain).otherwise(part(1)).alias("name"), F.when(coded, part(2)).otherwise("").alias("body"))
    about = F.regexp_extract("name", r"^(L1|Birth|Birthplace) of ([A-Za-z0-9]+)$", 1)
    r = r.withColumns({"whom": F.regexp_extract("name", r" of ([A-Za-z0-9]+)$", 1), "name": F.when(about != "", F.concat(about, F.lit(" of"))).otherwise(F.col("name"))})
    said = F.trim(F.regexp_replace(F.regexp_replace("body", r"\x15[^\x15]*\x15", ""), r"\[[^\[\]]*\]", " "))
    words = F.filter(F.split(said, r"[\s<>]+"), lambda w: (w != "") & ~w.startswith("&") & ~w.rlike(r"^[.?!,;]$|^\+[^\p{L}]|^\([.0-9:]+\)$"))
    items = F.filter(F.split("body", r"\s+"), lambda x: x != "")
    file, placed = Window.partitionBy("file"), Window.partitionBy("file").orderBy("line")
    upto, before = placed.rowsBetween(Window.unboundedPreceding, 0), placed.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"said": said, "words": F.when(F.col("kind") == "main", words).otherwise(F.array().cast("array<string>")), "items": items, "utterance": F.sum((F.col("kind") == "main").cast("int")).over(upto)})
    turn = F.when(F.col("kind") == "dependent", F.col("utterance"))
    gem = F.when((F.col("kind") == "header") & (F.col("name") == "Bg"), 1).when((F.col("kind") == "header") & (F.col("name") == "Eg"), -1).otherwise(0)
    r = r.withColumns({"_turn": turn, "_gem": gem, "_label": F.when(gem != 0, F.trim("body"))})
    people = F.flatten(F.collect_list(F.when((F.col("kind") == "header") & (F.col("name") == "Participants"), F.transform(F.split("body", ","), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)", 1)))).over(file))
    ids = F.collect_list(F.when((F.col("kind") == "header") & (F.col("name") == "ID"), F.trim(F.get(F.split("body", r"\|"), F.lit(2))))).over(file)
    same = Window.partitionBy("file", "_label").orderBy("line")
    return r.withColumns({
        "nth": F.row_number().over(Window.partitionBy("file", "kind", "_turn", "name").orderBy("line")),
        "codes": F.filter(people, lambda p: p != ""), "ids": ids, "headers": F.collect_set(F.when(F.col("kind") == "header", F.col("name"))).over(file), "is_last": F.col("line") == F.max("line").over(file),
        "mor": F.first(F.when((F.col("kind") == "dependent") & (F.col("name") == "mor"), F.col("items")), True).over(Window.partitionBy("file", "utterance")),
        "begun": F.coalesce(F.sum("_gem").over(before), F.lit(0)), "same": F.coalesce(F.sum("_gem").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.coalesce(-F.sum("_gem").over(same.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
    })


def report(lines: DataFrame, rules=RULES) -> DataFrame:
    """(file, line, code) of every rule that fires on ``lines`` (file, line, raw); a code once a line."""

    def fires(scope, condition):
        return F.expr(condition) if scope == "line" else F.expr(f"exists(words, w -> {condition})") if scope == "word" else F.col("is_last") & F.expr(condition)

    found = F.array_compact(F.array(*(F.when(fires(scope, condition), F.lit(code)) for code, scope, condition in rules)))
    return seen(lines).select("file", "line", F.explode(found).alias("code"))
