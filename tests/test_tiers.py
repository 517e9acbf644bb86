"""Groups of main tiers against a stack, and the balance of overlap marks against the scan it is described by."""

import random
import re

from loomspan.operators import groups, overlaps


def stacked(text):
    """(group, parent, depth, first, last, marks, retraced) and each token's group, by a stack."""
    t = re.findall(groups.TOKEN, text)
    stack, found, own, last = [0], {}, [], {}
    for at, x in enumerate(t):
        if x == "<":
            g = len(found) + 1
            found[g] = (stack[-1], len(stack), at)
            stack.append(g)
        own.append(stack[-1])
        if x == ">" and len(stack) > 1:
            last[stack.pop()] = at
    out, again = [], {0: False}
    for g, (parent, depth, first) in found.items():
        end, marks = last.get(g, len(t)), []
        for x in t[end + 1 :]:
            if not x.startswith("["):
                break
            marks.append(x)
        again[g] = again[parent] or bool(set(marks) & set(groups.RETRACES))
        out.append((g, parent, depth, first, end, marks, again[g]))
    return t, own, out, again


def texts(n=150, seed=3):
    rng = random.Random(seed)
    parts = ["<", "<", ">", ">", "[//]", "[?]", "[=! x y]", "a", "b", "&*MOT:oh_yes", "&*FAT:no", "xxx", "&-um", "0is", ".", "[/]"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(n)]
    return [*made, "", "<a <b <c> [/] d> [//] e> [?]", "> a <", "<<a>> [//] [!]"]


def test_groups_are_those_of_a_stack(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (9999, None)], "idx long, text string")
    got = {}
    for r in groups.groups(df, "idx").collect():
        got.setdefault(r.idx, []).append((r.group, r.parent, r.depth, r.first, r.last, list(r.marks), r.retraced))
    assert {i: sorted(g) for i, g in got.items()} == {i: s for i, t in rows if (s := stacked(t)[2])}
    kept = {(r.idx, r.at): (r.word, r.group, r.category, r.retraced) for r in groups.words(df, "idx").collect()}
    want = {}
    for i, t in rows:
        ts, own, _, again = stacked(t)
        for at, x in enumerate(ts):
            if x not in "<>" and not x.startswith(("[", "&*")):
                kind = "untranscribed" if x == "xxx" else "filler" if x == "&-um" else "omission" if x == "0is" else "mark" if x == "." else "word"
                want[i, at] = (x, own[at], kind, again[own[at]] or (at + 1 < len(ts) and ts[at + 1] in groups.RETRACES))
    assert kept == want


def test_events_come_in_the_order_in_which_groups_close(spark):
    rows = [(1, "A", "&*X:top_one <a &*X:outer <b &*Y:inner <c &*Z:deep> [/]> [//] d &*X:late> [?] <&*W:second> [/] &*X:top_two ."), (2, "B", "no events ."), (3, "C", "")]
    got = [(r.idx, r.nth, r.speaker, r.text) for r in groups.events(spark.createDataFrame(rows, "idx int, speaker string, text string").selectExpr("1 AS file", "*"), True).orderBy("idx", "nth").collect()]
    assert [t for i, n, _, t in got if i == 1 and n] == [f"+< {x} ." for x in ("deep", "inner", "outer", "late", "second", "top one", "top two")]
    assert [s for i, n, s, _ in got if i == 1 and n] == list("ZYXXWXX")
    assert [(i, n) for i, n, *_ in got if i != 1] == [(2, 0), (3, 0)]
    # any nesting: a group's events after those of the groups inside it
    rows = list(enumerate(texts(80, 5)))
    found = groups.events(spark.createDataFrame([(1, i, "A", t) for i, t in rows], "file int, idx int, speaker string, text string")).where("nth > 0").collect()
    for i, t in rows:
        ts, own, all_, _ = stacked(t)
        end = {g: last for g, _, _, _, last, *_ in all_}
        want = [x[2:5] for _, _, x in sorted((end.get(own[k], 10**9), k, x) for k, x in enumerate(ts) if x.startswith("&*"))]
        assert [r.speaker for r in sorted((r for r in found if r.idx == i), key=lambda r: r.nth)] == want


def regions(seed):
    rng, out = random.Random(seed), []
    for line in range(1, 40):
        speaker = rng.choice("ABC")
        for side in ("bottom", "top"):
            index = [rng.choice([None, None, 2]) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
            out += [(line, nth, side, speaker, x) for nth, x in enumerate(index)]
    return out


def scanned(rows):
    """Bottoms in order; tops of earlier utterances from the nearest back, skipping one that has this speaker's bottom while a sibling has none."""
    tops = [(r, []) for r in rows if r[2] == "top"]
    alone = []
    for line, nth, side, speaker, index in rows:
        if side == "top":
            continue
        for (tl, tn, _, ts, ti), partners in reversed([t for t in tops if t[0][0] < line]):
            if ts == speaker or ti != index:
                continue
            siblings = [p for (l, _, _, s, i), p in tops if (l, s, i) == (tl, ts, ti)]
            if speaker in partners and any(speaker not in p for p in siblings):
                continue
            partners.append(speaker)
            break
        else:
            alone.append((line, nth, "bottom"))
    groups_ = {}
    for (line, _, _, speaker, index), partners in tops:
        groups_.setdefault((line, speaker, index), []).append(len(partners))
    return alone, {k: sorted(v) for k, v in groups_.items()}


def test_balance_leaves_alone_what_the_scan_leaves_alone(spark):
    """Which of several sibling tops has no partner may differ from the scan back; how many, and which bottoms, may not."""
    rows = [(f, *r) for f in range(8) for r in regions(f)]
    got = overlaps.balance(spark.createDataFrame(rows, "file long, line long, nth int, side string, speaker string, index int").repartition(5)).collect()
    assert len(got) == len(rows)
    for f in range(8):
        alone, siblings = scanned(regions(f))
        mine = [r for r in got if r.file == f]
        assert sorted((r.line, r.nth, r.side) for r in mine if r.side == "bottom" and not r.partners) == sorted(alone)
        grouped = {}
        for r in mine:
            if r.side == "top":
                grouped.setdefault((r.line, r.speaker, r["index"]), []).append(r.partners)
        assert {k: sorted(v) for k, v in grouped.items()} == siblings
    # sibling tops are met in order
    two = [(1, 1, 0, "top", "A", None), (1, 1, 1, "top", "A", None), (1, 2, 0, "bottom", "B", None), (1, 3, 0, "bottom", "C", None)]
    got = overlaps.balance(spark.createDataFrame(two, "file long, line long, nth int, side string, speaker string, index int")).collect()
    assert {(r.line, r.nth): r.partners for r in got} == {(1, 0): 2, (1, 1): 0, (2, 0): 1, (3, 0): 1}


def test_a_tier_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "<a <b> [/] c> [//] d .")], "idx int, text string")
    for out in (groups.groups(df, "idx"), groups.words(df, "idx")):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.group, r.parent, r.marks, r.retraced) for r in groups.groups(df, "idx").collect()] == [(1, 0, ["[//]"], True), (2, 1, ["[/]"], True)]
