"""Edits of lines and tiers: inline events, overlap indices, replacements, layout, words of a recogniser, XML records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.groups import events  # noqa: F401

MARK = "[⌈⌊](?![2-9])"


def open_marks(lines: DataFrame) -> DataFrame:
    """EXP-03: (file, line, char, speaker, mark, nth): opening marks without an index of main lines (file, line, raw), with where
    they are and their number among those of their speaker and kind."""
    at = F.transform(F.regexp_extract_all("raw", F.lit(MARK), F.lit(0)), lambda m, i: F.struct((F.length(F.array_join(F.slice(F.split("raw", MARK, -1), F.lit(1), i + 1), "")) + i).alias("char"), m.alias("mark")))
    m = lines.where(F.col("raw").startswith("*")).select("file", "line", F.regexp_extract("raw", r"^\*([^:]*):", 1).alias("speaker"), F.inline(at))
    return m.withColumn("nth", F.row_number().over(Window.partitionBy("file", "speaker", "mark").orderBy("line", "char")))


def with_indices(lines: DataFrame, indices: DataFrame) -> DataFrame:
    """EXP-02: lines (file, line, raw) with the index of each opening mark (indices: file, line, char, index) written after it,
    but for 1, and counters: marks found, indexed, already (had one) and unmatched."""
    known = indices.groupBy("file", "line").agg(F.map_from_entries(F.collect_list(F.struct("char", "index"))).alias("known"))
    gaps, marks = F.split("raw", MARK, -1), F.regexp_extract_all("raw", F.lit(MARK), F.lit(0))
    char = lambda i: F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + i
    index = F.transform(marks, lambda m, i: F.when(F.col("known").isNotNull(), F.get(F.array(F.element_at("known", char(i))), F.lit(0))))
    put = F.zip_with(marks, F.col("put"), lambda m, x: F.concat(m, F.when(x > 1, x.cast("string")).otherwise("")))
    text = F.array_join(F.zip_with(gaps, put, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    already = F.regexp_count("raw", F.lit("[⌈⌊][2-9]"))
    indexed = F.size(F.array_compact("put"))
    j = lines.join(known, ["file", "line"], "left").withColumn("put", index)
    return j.select("file", "line", text.alias("raw"), (F.size(marks) + already).alias("found"), indexed.alias("indexed"), already.alias("already"), (F.size(marks) - indexed).alias("unmatched"))


def replaced(text: Column, table: dict[str, str]) -> Column:
    """SCF-30: every key of ``table`` replaced, the longest that fits at the leftmost place, in one pass."""
    pattern = "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k)))
    new = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    put = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.element_at(new, m))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


@dataclass
class Filter:
    """FLT-16: speakers, gems and words to keep or leave out, a range of utterances, and whether retraced words count."""

    speakers: list[str] = field(default_factory=list)
    not_speakers: list[str] = field(default_factory=list)
    gems: list[str] = field(default_factory=list)
    not_gems: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    not_words: list[str] = field(default_factory=list)
    first: int | None = None
    last: int | None = None
    retracings: bool = True

    def rows(self) -> Column:
        """The utterances (speaker, gem, idx) that stay."""
        keep = F.lit(True)
        for c, some, none in (("speaker", self.speakers, self.not_speakers), ("gem", self.gems, self.not_gems)):
            keep &= F.col(c).isin(*some) if some else F.lit(True)
            keep &= ~F.coalesce(F.col(c).isin(*none), F.lit(False)) if none else F.lit(True)
        keep &= F.lit(True) if self.first is None else F.col("idx") >= self.first
        return keep & (F.lit(True) if self.last is None else F.col("idx") <= self.last)

    def of(self, words: Column) -> Column:
        """The words that count: array<struct<word, retraced>> as array<string>."""
        fits = lambda w: (w.word.isin(*self.words) if self.words else F.lit(True)) & (~w.word.isin(*self.not_words) if self.not_words else F.lit(True)) & (F.lit(True) if self.retracings else ~w.retraced)
        return F.transform(F.filter(words, fits), lambda w: w.word)


# --- line edits (described by name and a few words; formulas are ours)


def lowered(text: Column, keep: str = r"I(?:'\w+)?|[A-Z]{2,}") -> Column:
    """CLN-20 (LOWCASE): words in lower case but for those that fit ``keep`` as a whole."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike(f"^(?:{keep})$"), w).otherwise(F.lower(w))), " ")


def fixed_bullets(rows: DataFrame) -> DataFrame:
    """CLN-20 (FIXBULLETS): starts not before the last end so far, ends not before starts."""
    before = F.max("end_ms").over(Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.col("start_ms"), F.coalesce(before, F.col("start_ms")))
    return rows.withColumn("start_ms", F.when(F.col("start_ms").isNotNull(), start)).withColumn("end_ms", F.when(F.col("end_ms").isNotNull(), F.greatest("end_ms", "start_ms")))


def without_retracings(text: Column) -> Column:
    """CLN-20 (RETRACE, FLO): retraced words and groups with their marks taken out."""
    bare = F.regexp_replace(text, r"(?:<[^<>]*>|\S+) \[/{1,3}\] ?", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def one_line(lines: DataFrame) -> DataFrame:
    """CLN-21 (LONGTIER): lines (file, line, raw) that start with a blank joined to the one before, each whole tier on one line."""
    own = ~F.col("raw").rlike(r"^\s")
    n = F.sum(own.cast("int")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    held = F.sort_array(F.collect_list(F.struct("line", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))))
    return lines.withColumn("n", n).groupBy("file", "n").agg(F.min("line").alias("line"), F.array_join(F.transform(held, lambda x: x.raw), " ").alias("raw")).drop("n")


def combined(tiers: DataFrame) -> DataFrame:
    """CLN-21 (COMBTIER): dependent tiers of one name under one main line (file, main, name, line, text) as one, in order."""
    held = F.sort_array(F.collect_list(F.struct("line", "text")))
    return tiers.groupBy("file", "main", "name").agg(F.min("line").alias("line"), F.array_join(F.transform(held, lambda x: x.text), " ").alias("text"))


def with_roles(participants: DataFrame, roles: dict[str, str]) -> DataFrame:
    """CLN-21 (ROLES): participants (code, role) with other roles by code."""
    new = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    return participants.withColumn("role", F.coalesce(F.element_at(new, F.col("code")), F.col("role")))


# --- words of a recogniser


def pieces(rows: DataFrame, most: int = 300) -> DataFrame:
    """NLP-02: words (file, nth, text) cut into turns: after a word with a terminator, and after ``most`` words at the latest."""
    w = Window.partitionBy("file").orderBy("nth")
    ends = F.coalesce(F.lag(F.col("text").rlike(r"[.?!]$")).over(w), F.lit(False))
    r = rows.withColumn("sentence", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy("file", "sentence").orderBy("nth")) - 1
    return r.withColumn("part", F.floor(at / most)).select("file", "sentence", "part", "nth", "text")


def compared(rows: DataFrame) -> DataFrame:
    """NLP-05: pairs array<struct<i, j>> of two lists of words (a, b) as steps array<struct<kind, word>>: match, or substitute
    of two words that are paired; delete of one that only a has, insert of one that only b has. Steps go by place."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    place = lambda i, j: F.array(F.struct(i.alias("i"), j.alias("j")))
    x = rows.withColumn("_ends", F.concat(place(F.lit(-1), F.lit(-1)), F.coalesce("pairs", F.array().cast("array<struct<i:int,j:int>>")), place(n("a"), n("b"))))
    step = lambda kind, word: F.struct(kind.alias("kind"), word.alias("word"))
    none = F.array().cast("array<struct<kind:string,word:string>>")

    def between(kind, side, first, last):
        return F.when(last > first, F.transform(F.sequence(first, last - 1), lambda k: step(F.lit(kind), F.get(side, k)))).otherwise(none)

    def stretch(k):
        """What lies between one pair and the next, inserted words first, and that pair, unless it is the end."""
        one, two = F.get("_ends", k - 1), F.get("_ends", k)
        pair = step(F.when(F.get("a", two.i) == F.get("b", two.j), "match").otherwise("substitute"), F.get("b", two.j))
        return F.concat(between("insert", "b", one.j + 1, two.j), between("delete", "a", one.i + 1, two.i), F.when(k < F.size("_ends") - 1, F.array(pair)).otherwise(none))

    return x.withColumn("steps", F.flatten(F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), stretch))).drop("_ends")


# --- records in XML

RECORDS = "transcript struct<r: array<struct<_id: string, orthography: struct<u: struct<w: array<string>, pause: array<string>>>, {}>>>"
_TIER = "{}: struct<pho: struct<pw: array<string>, pause: array<string>, silence: array<string>>>"


def xml_mismatches(files: DataFrame) -> DataFrame:
    """SRC-16, SCF-25: (file, record, tier, ortho_words, ortho_pauses, ipa_words, ipa_pauses, ortho_text) of the records of XML
    texts (file, text) whose words differ in number between the two tiers. Unreadable texts, and tiers without words, give none."""
    schema = RECORDS.format(", ".join(_TIER.format(t) for t in ("ipaTarget", "ipaActual"))) + ", broken string"
    r = files.select("file", F.from_xml("text", schema, {"columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}).alias("x")).where("x.broken is null").select("file", F.explode("x.transcript.r").alias("r")).where("r.orthography.u is not null")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = lambda c: F.greatest(n(c), F.lit(0))
    tier = lambda name, t: F.struct(F.lit(name).alias("tier"), count(F.col(f"r.{t}.pho.pw")).alias("ipa_words"), (count(F.col(f"r.{t}.pho.pause")) + count(F.col(f"r.{t}.pho.silence"))).alias("ipa_pauses"))
    u = "r.orthography.u"
    out = r.select("file", F.coalesce("r._id", F.lit("?")).alias("record"), count(F.col(f"{u}.w")).alias("ortho_words"), count(F.col(f"{u}.pause")).alias("ortho_pauses"), F.coalesce(F.array_join(f"{u}.w", " "), F.lit("")).alias("ortho_text"), F.inline(F.array(tier("target", "ipaTarget"), tier("actual", "ipaActual"))))
    return out.where("ipa_words > 0 and ortho_words <> ipa_words")


def mismatch_totals(mismatches: DataFrame) -> DataFrame:
    """AGG-15: mismatches and the files that have any."""
    return mismatches.agg(F.count("*").alias("mismatches"), F.countDistinct("file").alias("files"))
