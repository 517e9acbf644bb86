"""Every rule on lines in which it is planted, and no other rule with it."""

from loomspan.operators import rules

GOOD = ["@UTF8", "@Begin", "@Languages:\teng, fra", "@Participants:\tCHI Target_Child, MOT Mother", "@ID:\teng|c|CHI|2;06.10|||x|Target_Child|||", "@ID:\teng|c|MOT|||||Mother|||", "@Date:\t01-JAN-2020", "@Media:\tf1, audio",
        "@Bg:\tplay", "*CHI:\twell ˈhel:lo &-um (be)cause ice+cream . \x1510_20\x15", "%mor:\tn|a v|b .", "%gra:\t1|2|SUBJ 2|0|ROOT 3|2|PUNCT", "@Eg:\tplay", "*MOT:\t“ yes ” <so it> [//] it [: is] ⌈2 is ⌉2 xxx +...", "%xfoo:\tx", "@End"]
#: code -> the lines that take the place of the line that begins as they do (a line of None goes), and where it is reported
PLANTED = {
    "E501": ("@Date:", ["@Date:\t01-JAN-2020", "@Languages:\teng"], 1), "E505": ("@ID:\teng|c|MOT", ["@ID:\teng|c|MOT|||||Mother|"], 0), "E508": ("@Date:", ["@Date:\t"], 0), "E509": ("@Media:", ["@Media:\t"], 0),
    "E510": ("@ID:\teng|c|MOT", ["@ID:\t|c|MOT|||||Mother|||"], 0), "E512": ("@Participants:", ["@Participants:\tCHI Target_Child, , MOT Mother"], 0), "E513": ("@Participants:", ["@Participants:\tCHI Target_Child, MOT"], 0),
    "E515": ("@ID:\teng|c|MOT", ["@ID:\teng|c|MOT||||||||"], 0), "E517": ("@ID:\teng|c|CHI", ["@ID:\teng|c|CHI|2.6|||x|Target_Child|||"], 0), "E518": ("@Date:", ["@Date:\t2020-01-01"], 0), "E519": ("@Languages:", ["@Languages:\teng, french"], 0),
    "E524": ("@Date:", ["@Birth of FAT:\t01-JAN-2000"], 0), "E525": ("@Date:", ["@Datum:\t01-JAN-2020"], 0), "E526": ("@Eg:", [], -4), "E527": ("@Bg:", [], 3), "E529": ("*CHI:", ["@Bg:\tplay", "*CHI:\ta .", "@Eg:\tplay"], 0),
    "E530": ("*CHI:", ["@G:\tother", "*CHI:\ta ."], 0), "E533": ("@Date:", ["@Options:\t"], 0), "E304": ("*MOT:", ["*:\tyes ."], 0), "E308": ("*MOT:", ["*FAT:\tyes ."], 0), "E323": ("*MOT:", ["*MOT yes ."], 0), "E305": ("*MOT:", ["*MOT:\tyes"], 0),
    "E306": ("*MOT:", ["*MOT:\t."], 0), "E313": ("*MOT:", ["*MOT:\t( yes ."], 0), "E315": ("*MOT:", ["*MOT:\ty\x07es ."], 0), "E360": ("*MOT:", ["*MOT:\tyes . \x1510-20\x15"], 0), "E242": ("*MOT:", ["*MOT:\t“ yes ."], 0), "E230": ("*MOT:", ["*MOT:\t°yes ."], 0),
    "E356": ("*MOT:", ["*MOT:\t\x02\x01yes ."], 0), "E357": ("*MOT:", ["*MOT:\tyes\x02\x02 ."], 0), "E358": ("*MOT:", ["*MOT:\t&{l=X yes ."], 0), "E359": ("*MOT:", ["*MOT:\tyes &}l=X ."], 0), "E367": ("*MOT:", ["*MOT:\t&{n=X yes ."], 0), "E368": ("*MOT:", ["*MOT:\tyes &}n=X ."], 0),
    "E373": ("*MOT:", ["*MOT:\t⌈1 yes ⌉ ."], 0), "E208": ("*MOT:", ["*MOT:\tyes [: ] ."], 0), "E387": ("*MOT:", ["*MOT:\t&+ye [: yes] ."], 0), "E388": ("*MOT:", ["*MOT:\t&~ye [: yes] ."], 0), "E389": ("*MOT:", ["*MOT:\t&-ye [: yes] ."], 0),
    "E390": ("*MOT:", ["*MOT:\tyes [: it 0is] ."], 0), "E391": ("*MOT:", ["*MOT:\tyes [: xxx] ."], 0), "E220": ("*MOT:", ["*MOT:\tye5s ."], 0), "E232": ("*MOT:", ["*MOT:\tice+ ."], 0), "E233": ("*MOT:", ["*MOT:\tice++cream ."], 0), "E241": ("*MOT:", ["*MOT:\txx ."], 0),
    "E246": ("*MOT:", ["*MOT:\t:no ."], 0), "E247": ("*MOT:", ["*MOT:\tˈhelˈlo ."], 0), "E250": ("*MOT:", ["*MOT:\thelˌlo ."], 0), "E252": ("*MOT:", ["*MOT:\t^no ."], 0), "E231": ("*MOT:", ["*MOT:\tbe)cause ."], 0), "E401": ("%xfoo:", ["%com:\ta", "%com:\tb"], 1),
    "E404": ("@Bg:", ["@Bg:\tplay", "%com:\tearly"], 1), "E601": ("%xfoo:", ["%foo:\ta"], 0), "W601": ("%xfoo:", ["%xfoo:\t"], 0), "E604": ("%mor:", [], 0), "E702": ("%mor:", ["%mor:\tn v|b ."], 0), "E713": ("%gra:", ["%gra:\t1|9|SUBJ 2|0|ROOT 3|2|PUNCT"], 0),
    "E709": ("%gra:", ["%gra:\t1|2|SUBJ 3|0|ROOT 2|2|PUNCT"], 0), "E720": ("%gra:", ["%gra:\t1|2|SUBJ 2|0|ROOT"], 0), "E307": ("*MOT:", ["*MO.T:\tyes ."], 0), "E312": ("*MOT:", ["*MOT:\tyes [= so ."], 0), "E372": ("*MOT:", ["*MOT:\t“ yes “ no ” ” ."], 0),
    "E522": ("@ID:\teng|c|MOT", [], -2), "E523": ("@Date:", ["@ID:\teng|c|FAT|||||Father|||"], 0), "E511": ("@Date:", ["@ID:\teng|c||||||Mother|||"], 0), "E708": ("%gra:", ["%gra:\t1|2|subj 2|0|ROOT 3|2|PUNCT"], 0), "E244": ("*MOT:", ["*MOT:\tˈˌhello ."], 0), "E245": ("*MOT:", ["*MOT:\thelloˈ ."], 0),
    "E502": ("@End", [], -1), "E504": ("@Begin", [], 0), "E506": ("@Participants:", ["@Participants:\t"], 0), "E507": ("@Languages:", ["@Languages:\t"], 0),
}
#: Rules that fire along with one, as its line breaks them too.
WITH = {"E307": {"E308"}, "E506": {"E308", "E523"}, "E312": set(), "E505": set(), "E527": set(), "E244": set(), "E513": set()}


def planted(code):
    start, new, at = PLANTED[code]
    i = next(k for k, x in enumerate(GOOD) if x.startswith(start))
    return GOOD[:i] + new + GOOD[i + 1 :], i + at + 1


def test_rules_fire_where_they_are_planted_and_nowhere_else(spark):
    files = {0: GOOD} | {n: planted(code)[0] for n, code in enumerate(sorted(PLANTED), 1)}
    df = spark.createDataFrame([(f, i, raw) for f, lines in files.items() for i, raw in enumerate(lines, 1)], "file int, line int, raw string").repartition(4)
    got = {}
    for r in rules.report(df).collect():
        got.setdefault(r.file, set()).add((r.code, r.line))
    assert 0 not in got
    wrong = {}
    for n, code in enumerate(sorted(PLANTED), 1):
        found = got.get(n, set())
        codes = {c for c, _ in found} - WITH.get(code, set())
        line = len(files[n]) if code in ("E502", "E504") else planted(code)[1]
        if codes != {code} or (code, line) not in found:
            wrong[code] = sorted(found), line
    assert not wrong
    assert {c for c, *_ in rules.RULES} == set(PLANTED)


def test_files_are_apart_and_empty_ones_give_nothing(spark):
    none = spark.createDataFrame([], "file int, line int, raw string")
    assert rules.report(none).collect() == []
    assert rules.report(spark.createDataFrame([(1, 1, None), (1, 2, "")], "file int, line int, raw string")).select("code").distinct().count() == 2


def test_codes_are_stated_once():
    codes = [c for c, *_ in rules.RULES]
    assert len(codes) == len(set(codes)) >= 60
