"""Operator 3 [native]: format-preserving pseudonyms for personal numbers, dates, addresses and keys.

Values are found by one regular expression, validated, and mapped by a keyed Feistel network to another value of the
same format; equal values get equal pseudonyms in every document, and who holds the key can undo them. The network works
on pairs (left, right) from any two ranges: left takes up a keyed hash of right modulo its range, then right one of left,
eight times over, which permutes the product of the ranges.

kind   valid if                                        what is permuted
card   13 to 19 digits with a right Luhn digit          all digits but the first and the Luhn digit, which is made anew
phone  AAA EEE NNNN with or without 1 or +1 before it   AAA and EEE-NNNN, again from 200
       and signs between, AAA and EEE from 200
       + and 8 to 15 digits, the first not 1            all digits but the first two
ip     four numbers up to 255                           the four numbers
date   YYYY-MM-DD or with /, a day from 1900-01-01 to   the day, among those days
       2099-10-03; MM/DD/YYYY or with -; DD.MM.YYYY
       DD/MM/YYYY or with -, DD over 12, to 2099-12-22  the day, among days over 12
time   HH:MM or HH:MM:SS after YYYY-MM-DD and T or      hour and minute, or hour, minute and second, on their own
       blank (fractions and zones stay)
ssn    AAA-GG-NNNN, AAA not 000, 666 or from 900, GG    all three, among the valid ones
       not 00, NNNN not 0000
email  name@domain                                      the letters (made lower case) and digits of the name, in place
key    40 lower-case hexadecimal digits                 both halves

Cards are looked for in runs of digit groups with one blank or hyphen between, as stretches of whole groups. Single groups,
4-4-4-4 and 4-6-5 go first, then fewer groups, then the earlier start; a stretch that meets a chosen one is passed over. A
pseudonym that would make the run read as other stretches is mapped on until it doesn't, so that each run can be undone;
a card of several groups beside further digits may therefore have another pseudonym there. A run costs about the square
of the cards in it.

What fits no format, or is not valid, stays. Formatting (signs, blanks) stays. Nulls stay null and an empty text empty;
repeated rows and rows with equal ids are each treated; a very long text is searched whole, in its task's memory; an empty
table gives no rows; other columns are not read, but for n_values, _found and _new, which are replaced. No row meets another,
so skew does not arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

ROUNDS = 8
#: Forms that a run of digit groups doesn't take in. They look at places of digits only, which no pseudonym changes.
_OTHER = (
    r"[A-Za-z0-9._+-]{1,64}@|[0-9a-f]{40}(?![0-9A-Za-z])"
    r"|(?:\d{4}[/-]\d\d[/-]\d\d|\d\d[/-]\d\d[/-]\d{4}|\d{3}-\d\d-\d{4}|(?:\d[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4})(?!-?\d)"
)
_GROUP = r"\d++(?![A-Za-z_]|\.\d|-(?!\d))"
_END = r"(?!\w|-\d)"
PATTERN = (
    r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
    r"|\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\w+])\+[2-9](?:[ .()-]{0,2}\d){7,14}" + _END +
    r"|(?<![\w.+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END +
    r"|(?<![\w.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)"
    r"|(?<![\w.-])\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?(?![\d:])|(?![\w-]))"
    r"|(?<![\w./-])(?:\d{4}/\d\d/\d\d|\d\d(?:/\d\d/|-\d\d-|\.\d\d\.)\d{4})(?![\w/-]|\.\d)"
    r"|(?<![\w.-])\d{3}-\d\d-\d{4}" + _END +
    r"|(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])"
    r"|(?<![\w.-])(?=\d(?:[ -]?\d){12})" + _GROUP + r"(?:[ -](?!" + _OTHER + ")" + _GROUP + r")*+"
)
DAYS = (256, 285)
#: Days over 12 of a month, from 1900-01-13 on.
LATE_DAYS = (158, 280)
#: Steps of a walk from one run of digits to the next with the same cards. A step fails only where it makes or breaks
#: a card in the groups about; a card for which all fail is left and counted in n_left.
STEPS = 64


def _hash(key: str, kind, turn: int, value: Column) -> Column:
    """A keyed hash as a number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, F.lit(str(turn)), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, m_left, m_right, key: str, kind, back: bool = False) -> Column:
    """struct<left, right>: the pair permuted within [0, m_left) x [0, m_right); ``back`` undoes it."""
    m_left, m_right = (F.lit(m) if isinstance(m, int) else m for m in (m_left, m_right))
    sign = F.lit(-1 if back else 1)

    def step(turn):
        def turned(s):
            if turn % 2:
                return F.struct(s.left.alias("left"), F.pmod(s.right + sign * (_hash(key, kind, turn, s.left) % m_right), m_right).alias("right"))
            return F.struct(F.pmod(s.left + sign * (_hash(key, kind, turn, s.right) % m_left), m_left).alias("left"), s.right.alias("right"))

        return turned

    state = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        # each state is bound once, so that the expression grows with the turns and not with powers of two
        state = _bind(state, step(turn))
    return state


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permute_digits(value: Column, key: str, kind: str, digits: str = "0123456789", back: bool = False) -> Column:
    """A string over ``digits``, as another of the same length, 20 of them at a time; one alone is shifted."""

    def part(v):
        half, rest = F.floor(F.length(v) / 2).cast("int"), F.ceil(F.length(v) / 2).cast("int")
        size = lambda n: F.pow(F.lit(len(digits)), n).cast("long")
        pair = feistel(_number(F.substr(v, F.lit(1), half), digits), _number(F.substr(v, half + 1), digits), size(half), size(rest), key, kind, back)
        return _bind(pair, lambda p: F.concat(F.when(half > 0, _spelled(p.left, half, digits)).otherwise(F.lit("")), _spelled(p.right, rest, digits)))

    pieces = F.regexp_extract_all(value, F.lit("(?s).{1,20}"), F.lit(0))
    return F.array_join(F.transform(pieces, part), "")


def _number(v: Column, digits: str) -> Column:
    if len(digits) == 26:
        # base 26: letters a to z stand for the digits 0 to 9 and a to p
        v = F.translate(v, digits, "0123456789abcdefghijklmnop")
    return F.coalesce(F.conv(F.when(v == "", F.lit("0")).otherwise(v), len(digits), 10).cast("long"), F.lit(0))


def _spelled(n: Column, length: Column, digits: str) -> Column:
    text = F.lower(F.conv(n.cast("string"), 10, len(digits)))
    out = F.concat(F.repeat(F.lit("0"), length - F.length(text)), text)
    return F.translate(out, "0123456789abcdefghijklmnop", digits) if len(digits) == 26 else out


def _fill(template: Column, letters: str, symbols: Column) -> Column:
    """``template`` with its characters of the class ``letters`` replaced, in order, by ``symbols``."""
    cs = F.split(template, "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(template, F.lit(1), i + 1), f"[^{letters}]", ""))
    return F.array_join(F.transform(cs, lambda c, i: F.when(c.rlike(f"[{letters}]"), F.substr(symbols, nth(i), F.lit(1))).otherwise(c)), "")


def _only(value: Column, letters: str) -> Column:
    return F.regexp_replace(value, f"[^{letters}]", "")


def _luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def _card(d: Column, key: str, back: bool) -> Column:
    """A card's digits, permuted."""
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", back=back))
    return _bind(body, lambda b: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))), _luhn), F.lit(0)))


def _stretches(groups: Column) -> Column:
    """Whole groups in a row with 13 to 19 digits, as array<struct<other, k, i, at, size>> in the order in which they are tried."""
    n = F.size(groups)
    digits = lambda i, k: F.length(F.array_join(F.slice(groups, i + 1, k), ""))
    shape = lambda i, k: F.array_join(F.transform(F.slice(groups, i + 1, k), lambda g: F.length(g).cast("string")), "-")

    def at(i):
        size = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: F.struct(k.alias("k"), digits(i, k).alias("size")))
        fit = F.filter(size, lambda x: x["size"].between(13, 19))
        return F.transform(fit, lambda x: F.struct(((x.k > 1) & ~shape(i, x.k).isin("4-4-4-4", "4-6-5")).alias("other"), x.k.alias("k"), i.alias("i"), F.length(F.array_join(F.slice(groups, F.lit(1), i), "")).alias("at"), x["size"].alias("size")))

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def _chosen(tried: Column, digits: Column) -> Column:
    """The cards among the stretches ``tried`` of ``digits``."""
    valid = F.filter(tried, lambda c: _luhn(_part(digits, c)))
    meets = lambda a, c: (a.at < c.at + c["size"]) & (c.at < a.at + a["size"])
    return F.reduce(valid, F.filter(tried, lambda c: F.lit(False)), lambda acc, c: F.when(F.exists(acc, lambda a: meets(a, c)), acc).otherwise(F.concat(acc, F.array(c))))


def _part(digits: Column, c: Column) -> Column:
    return F.substr(digits, c.at + 1, c["size"])


def _run(m: Column, key: str, back: bool) -> Column:
    """struct<text, n, left>: a run of digit groups with its cards mapped, their number, and that of cards left as they are."""

    def walked(tried, cards, digits, c):
        def step(s, _):
            mapped = F.concat(F.substr(s.d, F.lit(1), c.at), _card(_part(s.d, c), key, back), F.substr(s.d, c.at + c["size"] + 1))
            return F.when(s.ok, s).otherwise(_bind(mapped, lambda d: F.struct(d.alias("d"), (_chosen(tried, d) == cards).alias("ok"))))

        return F.reduce(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(digits.alias("d"), F.lit(False).alias("ok")), step, lambda s: F.when(s.ok, s.d))

    def woven(groups, digits):
        new = F.transform(groups, lambda g, i: F.substr(digits, F.length(F.array_join(F.slice(groups, F.lit(1), i), "")) + 1, F.length(g)))
        return F.array_join(F.zip_with(new, F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")

    def mapped(groups, tried, cards):
        digits = F.array_join(groups, "")
        # in turn, the last one first to undo: the others then are as they were when it was mapped
        order = F.reverse(cards) if back else cards
        # a card for which no step gave a run with the same cards stays as it is, and is counted
        start = F.struct(digits.alias("d"), F.lit(0).alias("left"))
        done = F.reduce(order, start, lambda s, c: _bind(walked(tried, cards, s.d, c), lambda d: F.struct(F.coalesce(d, s.d).alias("d"), (s.left + F.when(d.isNull(), 1).otherwise(0)).alias("left"))))
        return _bind(done, lambda s: F.struct(woven(groups, s.d).alias("text"), F.size(F.filter(cards, lambda c: _part(digits, c) != _part(s.d, c))).alias("n"), s.left.alias("left")))

    def many(groups):
        return _bind(_stretches(groups), lambda tried: _bind(_chosen(tried, F.array_join(groups, "")), lambda cards: F.when(F.size(cards) > 0, mapped(groups, tried, cards)).otherwise(_counted(m, m))))

    return _bind(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), many)


def _counted(m: Column, new: Column) -> Column:
    return _bind(new, lambda x: F.struct(x.alias("text"), F.when(x != m, 1).otherwise(0).alias("n"), F.lit(0).alias("left")))


def _abroad(m: Column, key: str, back: bool) -> Column:
    return _bind(_only(m, "0-9"), lambda d: _bind(permute_digits(F.substr(d, F.lit(3)), key, "abroad", back=back), lambda p: _fill(m, "0-9", F.concat(F.substr(d, F.lit(1), F.lit(2)), p))))


def _pair(left: Column, right: Column, m_left: int, m_right: int, kind: str) -> Column:
    return F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"), F.lit(m_left).cast("long").alias("m_left"), F.lit(m_right).cast("long").alias("m_right"), F.lit(kind).alias("kind"))


def _months(day: Column) -> Column:
    return (F.year(day) - 1900) * 12 + F.month(day) - 1


def _late_before(k: Column) -> Column:
    """Days over 12 in the ``k`` months from 1900 on."""
    first = F.lit("1900-01-01").cast("date")
    return F.datediff(F.add_months(first, k), first) - 12 * k


def _late_day(n: Column) -> Column:
    """The ``n``th day over 12; its month is one of those about the mean place."""
    guess = F.floor(n / 18.437).cast("int")
    month = F.array_max(F.filter(F.sequence(F.greatest(guess - 3, F.lit(0)), guess + 3), lambda k: _late_before(k) <= n))
    return _bind(month, lambda k: F.date_add(F.add_months(F.lit("1900-01-01").cast("date"), k), (n - _late_before(k) + 12).cast("int")))


def _pairs(m: Column, kind: Column) -> Column:
    """What is permuted of a phone, ip, date or ssn: one pair, and one for the time of a date; none if it is not valid."""
    d = F.right(_only(m, "0-9"), F.lit(10)).cast("long")
    o = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("long")
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n))
    area, group, serial = (part(a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    first = F.lit("1900-01-01").cast("date")

    def day(x):
        n = F.datediff(x, first)
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _pair(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, "date"))

    def late(x):
        n = F.datediff(x, first) - 12 * (_months(x) + 1)
        return F.when(n.between(0, LATE_DAYS[0] * LATE_DAYS[1] - 1), _pair(F.floor(n / LATE_DAYS[1]), n % LATE_DAYS[1], *LATE_DAYS, "late"))

    places = F.when(m.rlike(r"^\d{4}"), F.concat(part(1, 4), F.lit("-"), part(6, 2), F.lit("-"), part(9, 2))).when((part(3, 1) == ".") | (part(1, 2) > "12"), F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2))).otherwise(F.concat(part(7, 4), F.lit("-"), part(1, 2), F.lit("-"), part(4, 2)))
    date = _bind(places.try_cast("date"), lambda x: F.when(m.rlike(r"^\d\d[/-]") & (part(1, 2) > "12"), late(x)).otherwise(day(x)))
    h, mi, sec = (part(a, 2).try_cast("long") for a in (12, 15, 18))
    time = F.when((F.length(m) == 16) & (h < 24) & (mi < 60), _pair(h, mi, 24, 60, "minute")).when((F.length(m) == 19) & (h < 24) & (mi < 60) & (sec < 60), _pair(h, mi * 60 + sec, 24, 3600, "time"))
    return (
        F.when(kind == "phone", F.array(F.when((d >= 200 * 10**7) & (d % 10**7 >= 2 * 10**6), _pair(F.floor(d / 10**7) - 200, d % 10**7 - 2 * 10**6, 800, 8 * 10**6, "phone"))))
        .when(kind == "ip", F.array(F.when((o(0) < 256) & (o(1) < 256) & (o(2) < 256) & (o(3) < 256), _pair(o(0) * 256 + o(1), o(2) * 256 + o(3), 1 << 16, 1 << 16, "ip"))))
        .when(kind == "ssn", F.array(F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn"))))
        .when(kind == "date", F.array(date, time))
    )


def _number_like(m: Column, kind: Column, key: str, back: bool) -> Column:
    """A phone, ip, date or ssn with its pairs permuted."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    joined = lambda sign, a, b, c: F.concat(a, sign, b, sign, c)
    sign, iso = F.substr(m, F.lit(3), F.lit(1)), m.rlike(r"^\d{4}")

    def day(p):
        n = (p.left * F.when(p.kind == "late", LATE_DAYS[1]).otherwise(DAYS[1]) + p.right).cast("int")
        x = F.when(p.kind == "late", _late_day(n)).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), n))
        y, mo, d = F.date_format(x, "yyyy"), F.date_format(x, "MM"), F.date_format(x, "dd")
        return F.when(iso, joined(F.substr(m, F.lit(5), F.lit(1)), y, mo, d)).when((p.kind == "late") | (sign == "."), joined(sign, d, mo, y)).otherwise(joined(sign, mo, d, y))

    def written(ps):
        p, t = F.get(ps, F.lit(0)), F.get(ps, F.lit(1))
        digits = _only(m, "0-9")
        phone = _fill(m, "0-9", F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), ((p.left + 200) * 10**7 + p.right + 2 * 10**6).cast("string")))
        ip = F.concat_ws(".", *(x.cast("string") for x in (F.floor(p.left / 256), p.left % 256, F.floor(p.right / 256), p.right % 256)))
        ssn = F.concat_ws("-", pad(p.left + F.when(p.left >= 665, 2).otherwise(1), 3), pad(F.floor(p.right / 9999) + 1, 2), pad(p.right % 9999 + 1, 4))
        time = F.when(t.kind == "minute", F.concat_ws(":", pad(t.left, 2), pad(t.right, 2))).when(t.kind == "time", F.concat_ws(":", pad(t.left, 2), pad(F.floor(t.right / 60), 2), pad(t.right % 60, 2)))
        dated = F.concat(F.coalesce(day(p), F.left(m, F.lit(10))), F.substr(m, F.lit(11), F.lit(1)), F.coalesce(time, F.substr(m, F.lit(12))))
        return F.when(kind == "date", dated).when(p.left.isNull(), m).when(kind == "phone", phone).when(kind == "ip", ip).otherwise(ssn)

    def permuted(x):
        pair = feistel(x.left, x.right, x.m_left, x.m_right, key, x.kind, back)
        return _bind(pair, lambda p: F.struct(p.left.alias("left"), p.right.alias("right"), x.kind.alias("kind")))

    return _bind(F.transform(_pairs(m, kind), lambda x: F.when(x.isNotNull(), permuted(x))), written)


def _email(m: Column, key: str, back: bool) -> Column:
    name = F.lower(F.substring_index(m, "@", 1))
    letters, numbers = _only(name, "a-z"), _only(name, "0-9")
    other = F.when(letters == "", name).otherwise(_bind(permute_digits(letters, key, "letters", "abcdefghijklmnopqrstuvwxyz", back), lambda s: _fill(name, "a-z", s)))
    done = _bind(other, lambda n: F.when(numbers == "", n).otherwise(_bind(permute_digits(numbers, key, "digits", back=back), lambda s: _fill(n, "0-9", s))))
    return F.concat(done, F.lit("@"), F.substring_index(m, "@", -1))


def _key(m: Column, key: str, back: bool) -> Column:
    return permute_digits(m, key, "key", "0123456789abcdef", back)


def kind_of(m: Column) -> Column:
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(m.startswith("+") & ~m.startswith("+1"), "abroad").when(m.startswith("+1") | m.rlike(r"^(1[ .-])?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^(\d{4}-\d\d-\d\d([T ].*)?|\d{4}/\d\d/\d\d|\d\d(/\d\d/|-\d\d-|\.\d\d\.)\d{4})$"), "date")
        .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn").when((F.length(m) == 40) & m.rlike("^[0-9a-f]+$"), "key").otherwise("card")
    )


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """struct<text, n, left>: the pseudonym of one found value, or the value itself if it is not valid, how many values differ, and
    how many valid cards stay as they are (see ``STEPS``)."""

    def of(kind):
        other = F.when(kind == "email", _email(m, key, back)).when(kind == "key", _key(m, key, back)).when(kind == "abroad", _abroad(m, key, back)).otherwise(_number_like(m, kind, key, back))
        return F.when(kind == "card", _run(m, key, back)).otherwise(_counted(m, other))

    return _bind(kind_of(m), of)


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten, n_values: how many values were replaced, and n_left: how many valid ones could not be."""
    found = docs.withColumn("_found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = found.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key, back)))
    woven = F.array_join(F.zip_with(F.split("text", PATTERN, -1), "_new", lambda gap, new: F.concat(gap, F.coalesce(new.text, F.lit("")))), "")
    n, left = F.reduce("_new", F.lit(0), lambda total, x: total + x["n"]), F.reduce("_new", F.lit(0), lambda total, x: total + x["left"])
    return found.withColumn("text", F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))).withColumns({"n_values": F.coalesce(n, F.lit(0)).cast("long"), "n_left": F.coalesce(left, F.lit(0)).cast("long")}).drop("_found", "_new")


def op3_pii(spark: SparkSession, sf_dir: str, key: str = "a key for tests only") -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key).drop("n_left")
