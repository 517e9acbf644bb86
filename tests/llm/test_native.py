"""Native operators: folding, escaping, mixing, pseudonyms, rules, decontamination edges."""

from collections import Counter
from math import ceil


def test_fold_and_read_back(spark):
    from pyspark.sql import functions as F

    from loomspan.llm.chat import fold, read_back, render

    log = [
        (1, 0, 0, "message", "user", "hi \\ <|im_end|>\n"), (1, 1, 1, "message", "assistant", "a"), (1, 2, 1, "delta", "assistant", "b"), (1, 3, 1, "edit", "assistant", "c"),
        (1, 4, 1, "delta", "assistant", "d"), (1, 5, 2, "message", "user", "gone"), (1, 6, 1, "regenerate", "assistant", None), (1, 7, 1, "message", "assistant", "n"), (1, 8, 1, "delta", "assistant", "ew<\\|"),
        (2, None, None, None, None, None), (3, 1, 5, "delta", "ro%le\n<", "late"), (4, 1, 1, "message", "user", "x"), (4, 1, 1, "message", "user", "x"), (4, 2, 1, "edit", "user", "y"),
    ]
    done = render(fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")))
    got = {r.conv_id: r for r in done.withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hi \\ <|im_end|>\n"), ("assistant", "new<\\|")]
    assert [s.text for s in got[1].segments if s.loss] == ["new<\\\\|"] and got[1].formatted.count("<|im_end|>") == 2
    assert [tuple(t) for t in got[2].turns] == [("", "")] and [tuple(t) for t in got[3].turns] == [("ro%le\n<", "late")]
    assert [tuple(t) for t in got[4].turns] == [("user", "x"), ("user", "y")]
    assert render(fold(spark.createDataFrame([], "conv_id long, seq long, turn long, kind string, role string, text string"))).count() == 0
    # a very long text and columns named as the operator's own
    wide = spark.createDataFrame([(1, 0, 0, "message", "assistant", "<|x|>\\" * 100_000, 1, "f", 2)], "conv_id long, seq long, turn long, kind string, role string, text string, message int, formatted string, i int")
    r = render(fold(wide)).withColumn("turns", read_back(F.col("formatted"))).first()
    assert r.n_turns == 1 and r.turns[0].text == "<|x|>\\" * 100_000


def test_timetable(spark):
    """By earliest deadline, less than one block off, however the period is cut."""
    from loomspan.llm.mixing import timetable

    parts = [5, 3, 1, 7]
    want, had = [], [0] * 4
    for t in range(16):
        want.append(min((ceil((had[k] + 1) * 16 / p), k) for k, p in enumerate(parts) if had[k] * 16 // p <= t)[1])
        had[want[-1]] += 1
    for span in (1 << 18, 5):
        owners = [r.k for r in timetable(spark, parts, span).orderBy("offset").collect()]
        assert owners == want
        done = Counter()
        for t, k in enumerate(owners, 1):
            done[k] += 1
            assert all(abs(done[j] - p * t / 16) < 1 for j, p in enumerate(parts))
    got = timetable(spark, [2, 1201]).orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(1203)) and sorted((r.k, r.nth) for r in got) == [(k, i) for k, n in enumerate((2, 1201)) for i in range(n)]


def test_mixing(spark):
    from loomspan.llm.mixing import mix

    rows = [(i, "abc" * (i % 5), f"s{i % 3}", "z") for i in range(400)] + [(None, None, None, "z"), (7, "x" * 500, "s1", "z"), (7, "x" * 500, "s1", "z"), (8, "y" * 70_000, "s2", "z")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, slot string"), {"s0": 2, "absent": 9}, block_size=40).collect()
    assert Counter((r.doc_id, r.source, r.n_chars) for r in got) == Counter((d, s, len(t or "")) for d, t, s, _ in rows)
    at = Counter()
    for r in sorted(got, key=lambda r: (str(r.source), -1 if r.doc_id is None else r.doc_id)):
        assert r.block == at[r.source] // 40 and r.release <= r.slot < r.deadline and r.deadline == ceil((r.block + 1) * 5 / (2 if r.source == "s0" else 1))
        at[r.source] += r.n_chars
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got}) == len({(r.source, r.block) for r in got})
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_of_many_sources(spark):
    """More sources than a span has slots; each still keeps its windows."""
    from loomspan.llm.mixing import mix

    rows = [(i, "x" * 30, f"h{i % 300}") for i in range(900)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"h5": 3, "h7": 3}, block_size=10, span=128).collect()
    assert len(got) == 900 and all(r.release <= r.slot < r.deadline for r in got) and len({r.slot for r in got}) == 900
    assert {r.deadline for r in got if r.block == 0} == {ceil(304 / 3), 304}


def test_pseudonyms(spark):
    from loomspan.llm.pii import pseudonymise

    texts = ["card 4785380592391139, 9870157079875996; 4111 1111 1111 1111.", "tel +1 (743) 555-3824 x hein.19@mail5.example.com y", "233.233.171.252 999.1.1.1 2021-02-28 2021-02-30", "f" * 40, None, "", "4785380592391139 a@b.de 9@x.org"]
    frame = spark.createDataFrame([(i % 5, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, other int")
    out = pseudonymise(frame, "k")
    got = [r.text for r in out.collect()]
    assert "4785380592391139" not in got[0] and "9870157079875996" in got[0] and got[0][5:21] in got[6]
    assert "hein" not in got[1] and "743" not in got[1] and "999.1.1.1" in got[2] and "2021-02-30" in got[2] and "2021-02-28" not in got[2]
    assert got[4] is None and got[5] == "" and [r.n_values for r in out.collect()] == [2, 2, 2, 1, 0, 0, 3]
    assert [r.text for r in pseudonymise(out.drop("n_values"), "k", back=True).collect()] == texts
    assert pseudonymise(frame, "other").first().text != got[0]
    assert pseudonymise(frame.where("false"), "k").count() == 0


def test_pseudonyms_against_plain_python(spark):
    """The Feistel network of the module's docstring, written anew with Python's own numbers."""
    from hashlib import sha256

    from loomspan.llm.pii import ROUNDS, pseudonymise

    def keyed(kind, turn, value):
        return int(sha256(f"k:{kind}:{turn}:{value}".encode()).hexdigest()[:15], 16)

    def pair(left, right, m_left, m_right, kind):
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + keyed(kind, turn, left) % m_right) % m_right
            else:
                left = (left + keyed(kind, turn, right) % m_left) % m_left
        return left, right

    def spell(n, width, base):
        out = ""
        for _ in range(width):
            n, d = divmod(n, len(base))
            out = base[d] + out
        return out

    def word(v, kind, base="0123456789"):
        out = ""
        for at in range(0, len(v), 20):
            p = v[at : at + 20]
            half = len(p) // 2
            number = lambda x: sum(base.index(c) * len(base) ** i for i, c in enumerate(reversed(x)))  # noqa: B023, E731
            a, b = pair(number(p[:half]), number(p[half:]), len(base) ** half, len(base) ** (len(p) - half), kind)
            out += spell(a, half, base) + spell(b, len(p) - half, base)
        return out

    def card(d):
        body = d[0] + word(d[1:-1], "card")
        total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def phone(d):
        a, b = pair(int(d[:3]) - 200, int(d[3:]) - 2_000_000, 800, 8_000_000, "phone")
        return f"{a + 200}{b + 2_000_000}"

    def ip(v):
        a, b, c, d = map(int, v.split("."))
        x, y = pair(a * 256 + b, c * 256 + d, 1 << 16, 1 << 16, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    def day(v):
        from datetime import date, timedelta

        a, b = pair(*divmod((date.fromisoformat(v) - date(1900, 1, 1)).days, 285), 256, 285, "date")
        return (date(1900, 1, 1) + timedelta(days=a * 285 + b)).isoformat()

    p = phone("7435553824")
    letters, numbers = word("hein", "letters", "abcdefghijklmnopqrstuvwxyz"), word("19", "digits")
    hexes = "0123456789abcdef" * 2 + "01234567"
    cases = {
        "4785380592391139": card("4785380592391139"), "378282246310005": card("378282246310005"), "+1 (743) 555-3824": f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", "743-555-3824": f"{p[:3]}-{p[3:6]}-{p[6:]}",
        "233.233.171.252": ip("233.233.171.252"), "2021-02-28": day("2021-02-28"), "1900-01-01": day("1900-01-01"), "hein.19@mail5.example.com": f"{letters}.{numbers}@mail5.example.com", hexes: word(hexes, "key", "0123456789abcdef"),
    }
    texts = [f"x {v} y" for v in cases] + ["lorem " * 100_000 + "4785380592391139"]
    got = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [got[i] for i in range(len(cases))] == [f"x {v} y" for v in cases.values()]
    assert got[len(cases)] == "lorem " * 100_000 + card("4785380592391139")


def test_pseudonyms_in_runs_and_other_forms(spark):
    import random

    from loomspan.llm.pii import pseudonymise

    card, other = "4785380592391139", "4111111111111111"
    spaced = "4111 1111 1111 1111"
    phones = ["743-555-3824", "(743) 555-3824", "+44 20 7946 0958", "1-743-555-3824", "743.555.3824", "743 555 3824", "+17435553824"]
    days = ["03/14/1999", "14/03/1999", "31/12/2098", "14.03.1999", "2021/02/28", "2021-02-28T10:11:12Z", "2021-02-28 23:59", "03-14-1999", "14-03-1999"]
    clear = ["123-45-6789", *phones, *days]
    runs = [f"pay {card} 123 now", f"{card} 12 times", f"12 {card} ok", f"{card}-{other}", f"123 {spaced}", f"{spaced} 1234 {spaced}", f"{card} 2021-02-28", f"{card} 743-555-3824", f"{card} 12.a@b.de"]
    texts = [f"x {v} y" for v in clear] + runs + ["000-12-3456 31/31/1999 123-456-7890 14.13.1999 2021-02-28T25:00:00"] + ["1" * 40]
    dice = random.Random(1)
    texts += [" ".join("".join(dice.choices("0123456789", k=dice.choice([1, 2, 4, 4, 4, 6, 13, 16]))) for _ in range(dice.randint(4, 14))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pseudonymise(frame, "k").cache()
    got = {r.doc_id: r for r in out.collect()}
    assert [r.text for r in sorted(pseudonymise(out.drop("n_values"), "k", back=True).collect(), key=lambda r: r.doc_id)] == texts
    for i, v in enumerate(clear):
        assert v not in got[i].text and got[i].n_values == 1 and len(got[i].text) == len(texts[i]), v
    new = got[len(clear)].text[4:20]
    for i, text in enumerate(runs, len(clear)):
        assert card not in got[i].text and other not in got[i].text and spaced not in got[i].text, text
        assert card not in text or new in got[i].text
    assert [got[len(clear) + i].n_values for i in (0, 3, 5, 6, 7, 8)] == [1, 2, 2, 2, 2, 2]
    assert "2021-02-28" not in got[len(clear) + 6].text and "743-555" not in got[len(clear) + 7].text and ".a@" not in got[len(clear) + 8].text
    invalid = got[len(clear) + len(runs)].text
    assert invalid.startswith("000-12-3456 31/31/1999 123-456-7890 14.13.1999 ") and invalid.endswith("T25:00:00")


def test_rules(spark):
    from loomspan.llm.urls import judge, rule_rows

    urls = ["https://a.NET/x", "https://example.net/en/1", "http://xexample.com/de/", "http://b.example.com/de/?q", "http://example.com", "https://q.org/fr/#x", "http://spam-farm.org/", "no", None, "http://net", "http://u.net?x"]
    got = {r.key: r for r in judge(spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "key long, url string"), rule_rows(spark)).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["net/", "example.net/en/", None, "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert (got[0].host, got[0].path, got[7].host, got[8].path) == ("a.net", "/x", "", "")


def test_urls_empty_long_and_clashing(spark):
    from loomspan.llm.urls import judge, rule_rows

    urls = [(0, "https://a.net/" + "x/" * 50_000, "r", "h"), (0, "https://a.net/" + "x/" * 50_000, "r", "h"), (1, "", None, None)]
    got = judge(spark.createDataFrame(urls, "key long, url string, rule string, host string"), rule_rows(spark)).collect()
    assert sorted((r.key, r.host, len(r.path), r.rule, r.verdict) for r in got if r.key == 0) == [(0, "a.net", 100_001, "net/", "block")] * 2
    assert [(r.host, r.path, r.rule, r.verdict) for r in got if r.key == 1] == [("", "", None, "allow")]
    assert judge(spark.createDataFrame([], "key long, url string"), rule_rows(spark)).count() == 0


def test_patterns_inside_tokens(spark):
    from loomspan.llm.urls import judge, rule_rows

    hits = ["https://x.org/supercheap-pills", "https://x.org/cheap-pillsy", "https://x.org/myspam-farm", "https://x.org/spam-farms", "https://x.org/CHEAP-pills/casino/"]
    names = ["cheap-pills", "cheap-pills", "spam-farm", "spam-farm", "casino"]
    for common in ("cheap", "pills", "spam", "farm"):
        urls = hits + ["https://x.org/cheap/pills", None] + [f"https://x.org/{common}"] * 3
        got = {r.key: r for r in judge(spark.createDataFrame(list(enumerate(urls)), "key long, url string"), rule_rows(spark)).collect()}
        assert [got[i].pattern for i in range(len(urls))] == names + [None] * 5
        assert [got[i].verdict for i in range(len(urls))] == ["block"] * 5 + ["allow"] * 5


def test_decontamination(spark):
    from loomspan.llm.decontaminate import contamination

    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:15])), (2, "Tiny item"), (3, None), (4, " ".join(words[3:13])), (None, "w1 w2"), (10, "tiny ITEM")]
    docs = [(1, "x " + " ".join(words[:15]).upper() + " y"), (2, "a tiny, item! tiny item"), (3, None), (4, " ".join(words[:9])), (1, "tiny"), (None, "item"), (5, " ".join(words[:6] + ["gap"] + words[6:10]))]
    frames = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, item_ids string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 8):
        got = contamination(*frames, slop=1, block_words=block).collect()
        by = {(r.doc_id, r.n_words): r for r in got}
        assert len(got) == len(docs)
        assert (by[1, 17].n_hit, by[1, 17].item_ids) == (15, ["1", "4"]) and (by[2, 5].n_hit, by[2, 5].item_ids) == (4, ["10", "2"])
        assert by[1, 17].near_ids == ["1", "4"]
        assert by[4, 9].n_hit == by[1, 1].n_hit == by[None, 1].n_hit == by[3, 0].n_hit == by[5, 11].n_hit == 0 and by[5, 11].near_ids == ["1"]
    # near places by brute force: one word put in, one left out, none across documents; and a very long text
    base = words[:15]
    texts = [base[:7] + ["new"] + base[7:], base[:5] + base[6:], base[:5], base[5:10], ["w1"] * 150_000 + base]
    got = {r.doc_id: r for r in contamination(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), frames[1].where("item_id in (1, 4)"), slop=1).collect()}

    def near(t, w):
        return any(all(any(0 <= s + k + o < len(t) and t[s + k + o] == x for o in (-1, 0, 1)) for k, x in enumerate(w)) for s in range(-1, len(t) + 1))

    for i, t in enumerate(texts[:4]):
        assert got[i].near_ids == [n for n, w in (("1", base), ("4", words[3:13])) if any(near(t, w[a : a + 10]) for a in range(len(w) - 9))]
    assert got[0].near_ids == ["1", "4"] and not got[0].item_ids[1:] and got[4].n_hit == 15 and got[4].n_words == 150_015
    assert contamination(frames[0], frames[1].where("false")).where("n_hit > 0").count() == 0
    assert contamination(frames[0].where("false"), frames[1]).count() == 0
