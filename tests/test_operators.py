"""Operators without SQL of their own, on small rows: brute force, round trips and worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import align, annotations, brackets, content, lines, metadata, sets, timing
from loomspan.operators.graph import components
from loomspan.sources import transcripts
from loomspan.streaming import jobs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_word_errors(spark):
    r = random.Random(3)
    some = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    pairs = [(some(r.randrange(12), 5), some(r.randrange(12), 5)) for _ in range(60)] + [([], []), (["é", "ab"], ["ab"]), (some(400, 300), some(380, 300))]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {x.i: x.e for x in df.select("i", align.word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: distance(a, b) for i, a, b in rows}
    # past the surrogates, each word still has a character of its own
    n = 56_000
    big = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")).alias("a")).select(F.size(F.array_distinct(F.transform(F.sequence(F.lit(0xD6FE), F.lit(0xD702)), lambda p: F.decode(F.unhex(F.lpad(F.hex(p + F.when(p < 0xD700, 0x100).otherwise(0x900)), 8, "0")), "UTF-32")))).alias("k"))
    assert big.first().k == 5


def raws(spark, *texts):
    return transcripts.numbered(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string"))


def test_layouts(spark):
    a, b, c = "0.00 9.21\tANN: \thello\n\n9.30 9.90\t\tmore", "2.660\t2.805\tBOB:\thi there\n3.0\t2.0\tBOB:\tback", "0.00 2.53 CY:   \ttext one\n00000 1.0 CY: \tzero"
    rows = transcripts.parsed(raws(spark, a, b, c)).orderBy("file", "line").collect()
    assert [(r.file, r.line, r.start, r.end, r.speaker, r.content, r.problem) for r in rows] == [
        ("f0", 1, 0.0, 9.21, "ANN", "hello", None), ("f0", 3, 9.3, 9.9, None, "more", None),
        ("f1", 1, 2.66, 2.805, "BOB", "hi there", None), ("f1", 2, 3.0, 2.0, "BOB", "back", "end before start"),
        ("f2", 1, 0.0, 2.53, "CY", "text one", None), ("f2", 2, 0.0, 0.0, "CY", "zero", "zero stamp"),
    ]


def test_decoded(spark):
    df = spark.createDataFrame([(bytearray(b"a\x00b\x92c\x7f\r\n\xe9\x80"),)], "c binary")
    assert df.select(transcripts.decoded(F.col("c"))).first()[0] == "acb'c\né€"


def test_tiers(spark):
    text = "@Begin\n*ANN:\t+< yes . \u001512_40\u0015\n%wor:\tyes \u001512_30\u0015\n%com:\tnote\nloose"
    t = transcripts.tiers(raws(spark, text))
    rows = t.orderBy("line").collect()
    assert [(r.kind, r.name, r.start_ms, r.end_ms, r.overlaps) for r in rows] == [("header", "Begin", None, None, False), ("main", "ANN", 12, 40, True), ("dependent", "wor", 12, 30, False), ("dependent", "com", None, None, False)]
    bare = transcripts.stripped(t).orderBy("line").collect()
    assert [r.name for r in bare] == ["Begin", "ANN", "com"] and bare[1].text == "+< yes ." and bare[1].start_ms is None
    moved = spark.createDataFrame([("a \u0015100_250\u0015 b \u00155_9\u0015",)], "t string").select(transcripts.rebased(F.col("t"), 50)).first()[0]
    assert moved == "a \u001550_200\u0015 b \u00150_0\u0015"


def test_lists(spark):
    assert [r.path for r in transcripts.path_list(raws(spark, "# note\n\n a/b \nc")).collect()] == ["a/b", "c"]
    asr = spark.createDataFrame([("f", '[{"text":"a","start_ms":1,"end_ms":2},{"text":"b","start_ms":3,"end_ms":4}]'), ("g", "broken")], "file string, raw string")
    assert [tuple(r) for r in transcripts.asr_tokens(asr).where("text is not null").orderBy("nth").collect()] == [("f", 0, "a", 1, 2), ("f", 1, "b", 3, 4)]
    utt = spark.createDataFrame([("f", 1, "A", "late", 900, 950), ("f", 2, "B", "none", None, None), ("f", 3, "A", "soon", 100, 200)], "file string, idx int, speaker string, text string, start_ms long, end_ms long")
    assert transcripts.document(utt).first().text == "@Begin\n*B:\tnone\n*A:\tsoon \u0015100_200\u0015\n*A:\tlate \u0015900_950\u0015\n@End"


@pytest.mark.parametrize(
    "text, want",
    [
        ("[2bar2]", [(0, "Open", 2), (5, "Close", 2)]),
        ("a [b] c", [(2, "Open", None), (4, "Close", None)]),
        ("((x [y])) [z$]", [(10, "Open", None), (12, "CloseForced", None)]),
        ("<<[q]>>", [(2, "Open", None), (4, "Close", None)]),
        ("none", []),
    ],
)
def test_bracket_tokens(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(brackets.tokens(F.col("t"))).first()[0]
    assert [(x.char_offset, x.kind, x["index"]) for x in got] == want


def test_crossing_is_a_stack(spark):
    r = random.Random(5)
    rows = [(f, i, k, r.random() < 0.5) for f in range(6) for i, k in enumerate(r.choices([0, 2], k=30))]
    want, held = {}, {}
    for f, i, k, is_open in rows:
        stack = held.setdefault((f, k), [])
        if is_open:
            stack.append(i)
        else:
            want[f, i] = stack.pop() if stack else None
    got = lines.crossing(spark.createDataFrame(rows, "file int, line int, key int, is_open boolean")).where("not is_open").collect()
    assert {(x.file, x.line): x.open_line for x in got} == want


def test_given_up(spark):
    rows = [("a", i, i == 2) for i in range(6)] + [("b", i, i % 2 == 0) for i in range(6)]
    got = jobs.given_up(spark.createDataFrame(rows, "job string, attempt int, ok boolean"), 3).collect()
    assert [tuple(r) for r in got] == [("a", 5)]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "k string, at timestamp, v int"
    one = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:05:00", 2), ("b", "2024-01-01 03:00:00", 3)], "k string, t string, v int")
    one.select("k", F.to_timestamp("t").alias("at"), "v").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)

    def rows(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.k for r in rows(jobs.once(read(), ["k"], "at"), "once")) == ["a", "b"]
    assert {r.k: r.n for r in rows(jobs.windowed(read(), "at", "k"), "windowed", "complete")} == {"a": 2, "b": 1}
    assert {r.k: r.n for r in rows(jobs.sessions(read(), "at", "k"), "sessions", "complete")} == {"a": 2, "b": 1}
    q = read().writeStream.foreachBatch(jobs.latest(spark, f"{tmp_path}/t", "k", "at")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/latest").start()
    q.awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/t/v0").collect()} == {"a": 2, "b": 3}


@pytest.mark.parametrize(
    "first, want",
    [
        ("0.00 9.21\tLENORE: \t... So you don't need to go", "A"), ("2.660\t2.805\tJOANNE:\tBut,", "B"), ("0.00 2.53 FRED:   \t... Okay.", "C"), ("77.540: 78.100:\tKEN:\tx", "A"), ("77.540 :\t78.100:\tKEN:\tx", "A"),
        ("1.0\t2.0", "B"), ("1.0 2.0\tcontent", "C"), ("no times at all", "A"), ("1.0 2.0 3.0\tA:\tx", "A"), ("1.2.3\t2\tA:\tx", "A"),
    ],
)
def test_layout_of_the_first_line(spark, first, want):
    assert transcripts.layouts(raws(spark, first)).first().layout == want


def test_speaker_fields(spark):
    names = ["JAMIE:", " Doris: ", ">ENV:", "#*X_2/?", "?WHO:", "A&B:", "'T:", "x", "xy", "", "   ", ":", ">", "JOAN"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, s string").orderBy("i").select(transcripts.speaker_of(F.col("s"))).collect()]
    assert got == ["JAMIE", "Doris", ">ENV", "#*X_2/?", None, None, None, None, "xy", None, None, None, None, "JOAN"]


def test_broken_lines(spark):
    long = " ".join(f"w{i}" for i in range(12_000))
    text = f"0.00 1.00\tANN:\tok\n1.5 2.5 BOB: {long}\n3.0 4.0 ... and so\n5.0 6.0\n000000000 000000000\t\t$ note\nx 1\tA:\tbad"
    rows = transcripts.parsed(raws(spark, text)).orderBy("line").collect()
    assert [(r.start, r.speaker, r.problem) for r in rows] == [(0.0, "ANN", None), (1.5, "BOB", None), (3.0, None, None), (5.0, None, "broken tabs"), (0.0, None, "zero stamp"), (None, "A", "bad stamp")]
    assert rows[1].content == long and rows[2].content == "... and so"
    k = transcripts.kept(transcripts.parsed(raws(spark, text))).orderBy("line").collect()
    assert [(r.effective, r.skip) for r in k] == [("ANN", False), ("BOB", False), ("BOB", False), ("BOB", True)]


def test_speaker_ids(spark):
    names = ["JAMIE", "HAROLD", "AL", "SHANE", "SHARON", "TOM_1", "KENDRA", "KEN", ">ENV", ">DOG", "ABCD", "ABCDEF", "ABCDE", "#*X", "*#X"]
    got = {r.speaker: r.id for r in lines.speaker_ids(spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, line int, speaker string")).collect()}
    assert got == {
        "JAMIE": "JAMI", "HAROLD": "HARO", "AL": "AL", "SHANE": "SHAN", "SHARON": "SHA", "TOM_1": "TOM1", "KENDRA": "KEND", "KEN": "KEN", ">ENV": "ENV", ">DOG": "DOG", "ABCD": "ABCD", "ABCDEF": "JUNK0", "ABCDE": "JUNK1", "#*X": "X", "*#X": "#X",
    }


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("A", False, 1), (None, False, 1), (None, False, 1), ("A", False, 1), ("B", False, 1)], [(1, 4, "A"), (5, 5, "B")]),
        ([("A", True, 1), (None, False, 1), ("A", True, 1), (None, False, 2)], [(1, 1, "A"), (2, 3, "A"), (4, 4, "A")]),
        ([(None, False, 1), ("A", False, 0), ("B", False, 1)], [(1, 1, ""), (3, 3, "B")]),
        ([("A", True, 0), (None, True, 1), (None, True, 0), (None, False, 1)], [(1, 2, "A"), (3, 4, "A")]),
    ],
)
def test_segments(spark, rows, want):
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows, 1)], "file string, line int, speaker string, ends boolean, n int").withColumn("skip", F.lit(False))
    assert [(r.first_line, r.last_line, r.speaker) for r in lines.segments(df).orderBy("utterance").collect()] == want


def test_a_skipped_line_still_ends(spark):
    df = spark.createDataFrame([("f", 1, "A", False, 1, False), ("f", 2, None, True, 1, True), ("f", 3, None, False, 1, False)], "file string, line int, speaker string, ends boolean, n int, skip boolean")
    assert [(r.first_line, r.last_line, r.lines) for r in lines.segments(df).orderBy("utterance").collect()] == [(1, 1, 1), (3, 3, 1)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("((open (x", ["Word ((", "Word open", "Word (", "Word x"]), ("(H)= (Hx) (TSK) (%Hx)", ["InhalationLengthened ", "Exhalation ", "Click ", "Vocalism %Hx"]), ("wo--rd -- ..", ["Word wo--rd", "Truncation ", "PauseShort "]),
        ("...(2) ...(x)", ["PauseTimed 2", "PauseMedium ", "Vocalism x"]), ("VOX> humVOX> FF> <@ hi @>", ["LongFeatureEnd VOX", "Word hum", "LongFeatureEnd VOX", "LongFeatureEnd FF", "LongFeatureBegin @", "Word hi", "LongFeatureEnd @"]),
        ("% %> é.", ["Glottal ", "LongFeatureEnd %", "Word é", "Period "]), ("a;b *", ["Word a;", "Word b", "Word *"]), ("((a [x])) [3y3$]", ["Comment a [x]", "Bracket [", "Word y", "Bracket ]"]), (None, None), ("", []),
    ],
)
def test_elements(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(content.elements(F.col("t"))).first()[0]
    assert (got if got is None else [f"{e.kind} {e.value}" for e in got]) == want


PAIR = "file string, pair int, open_id long, speaker string, line int, index int, t0 double, t1 double"


def roles(spark, pairs, edges=()):
    p = spark.createDataFrame([("f", i, i, *x) for i, x in enumerate(pairs)], PAIR)
    e = spark.createDataFrame([("f", a, b) for a, b in edges], "file string, id long, target long")
    links = brackets.overlapping(p).unionByName(brackets.aligned(e, p))
    return [(r.role, r.real_index) for r in brackets.sets_of(p, links).orderBy("pair").collect()]


@pytest.mark.parametrize(
    "pairs, edges, want",
    [
        ([("J", 1, None, 0.0, 6.0), ("H", 2, None, 4.0, 6.0)], [(1, 0)], [("top", 0), ("bottom", 0)]),
        ([("J", 1, None, 0.0, 6.0), ("J", 1, 2, 0.0, 6.0), ("H", 2, None, 4.0, 6.0), ("H", 2, 2, 4.0, 6.0)], [], [("top", 0), ("top", 1), ("bottom", 0), ("bottom", 1)]),
        ([("J", 1, None, 0.0, 6.0), ("H", 2, None, 4.0, 6.0), ("J", 30, None, 20.0, 26.0), ("M", 31, None, 24.0, 26.0)], [], [("top", 0), ("bottom", 0), ("top", 0), ("bottom", 0)]),
        ([("J", 1, 3, 0.0, 1.0)], [], [("top", 2)]),
        # tied by the edge alone: five lines apart and not at one time
        ([("J", 1, None, 0.0, 1.0), ("H", 6, None, 50.0, 51.0)], [(1, 0)], [("top", 0), ("bottom", 0)]),
        ([("J", 1, None, 0.0, 1.0), ("H", 6, None, 50.0, 51.0)], [], [("top", 0), ("top", 0)]),
        ([("J", 1, None, 0.0, 1.0), ("H", 6, 2, 50.0, 51.0)], [(1, 0)], [("top", 0), ("top", 1)]),
        # a second pair of one speaker goes to a set of its own
        ([("J", 1, None, 0.0, 6.0), ("H", 2, None, 4.0, 6.0), ("J", 3, None, 4.0, 9.0)], [], [("top", 0), ("bottom", 0), ("top", 0)]),
    ],
)
def test_roles(spark, pairs, edges, want):
    assert roles(spark, pairs, edges) == want


def test_components_of_a_long_path(spark):
    path = spark.range(700).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(path.unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(701)} | {1000: 1000, 1001: 1000}


def test_no_machine_local_folder_on_a_cluster(spark):
    class Away:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Away(), spark.conf

    class Links:
        sparkSession = Session()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            components(Links())


def test_consistency_by_the_end_of_the_bottom(spark):
    rows = [("f", 1, "A", 10_000, 12_000, True, False), ("f", 2, "B", 7_000, 9_000, False, True), ("g", 1, "A", 10_000, 12_000, True, False), ("g", 2, "B", 5_000, 7_999, False, True), ("h", 1, "A", 0, 100, True, False), ("h", 2, "B", 2_101, 3_000, False, True)]
    df = spark.createDataFrame(rows, "file string, idx int, speaker string, start_ms long, end_ms long, top_begin boolean, bottom_begin boolean").withColumns({"top_end": F.lit(False), "bottom_end": F.lit(False)})
    assert {r.file: (r.timed_pairs, r.temporal_ok) for r in timing.audit(df).collect()} == {"f": (1, 1), "g": (1, 0), "h": (1, 0)}


def test_error_places(spark):
    r = random.Random(7)
    for errors in ([r.randrange(-10**7, 10**7) for _ in range(501)], [5], [r.randrange(-3, 4) for _ in range(100)], [-60_000, 60_000, 59_999, 0]):
        df = spark.createDataFrame([("f", e) for e in errors] + [("f", None)], "file string, e long")
        a = sorted(map(abs, errors))
        want = (len(a), *(a[int(len(a) * x)] for x in (0.5, 0.9, 0.95)), sum(x <= 500 for x in a))
        for got in (timing.error_stats(df, "e").first(), timing.error_stats(df, "e", "file").first()):
            assert (got.n, got.median, got.p90, got.p95, got.within_500) == want


def test_nearest_marks(spark):
    r = random.Random(9)
    items = [("f", i, r.randrange(2), s := r.randrange(40_000), s + r.randrange(3_000)) for i in range(80)]
    marks = [("f", r.randrange(2), r.randrange(50_000)) for _ in range(25)] + [("f", 0, items[0][3]), ("f", 0, items[0][4])]
    want = {}
    for f, i, k, s, e in items:
        near = sorted((max(s - t, t - e, 0), t) for g, key, t in marks if (g, key) == (f, k))
        levels = [n for n, w in enumerate((500, max(e - s, 2000), max(2 * (e - s), 5000)), 1) if near and near[0][0] <= w]
        if levels:
            want[i] = (levels[0], near[0][1])
    got = timing.windows(spark.createDataFrame(items, "file string, id int, key int, start_ms long, end_ms long"), spark.createDataFrame(marks, "file string, key int, at_ms long")).collect()
    assert {x.id: (x.level, x.at_ms) for x in got} == want


def test_alignment(spark):
    assert [align.similarity(a, b) for a, b in (("a b", "a b"), ("a b", "xa by"), ("a b", "a b c"), ("a b c", "b c d"), ("", ""), ("", "a"))] == [100, 80, 80, 40, 10, 0]
    r = random.Random(2)
    rows = [(i, [r.choice("abc") * r.randint(1, 2) for _ in range(r.randrange(7))], [r.choice("abc") for _ in range(r.randrange(7))]) for i in range(40)]

    def best(a, b):
        score = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                score[i, j] = max([0] if not i + j else ([score[i - 1, j - 1] + align.similarity(a[i - 1], b[j - 1])] if i and j else []) + ([score[i - 1, j] - 5] if i else []) + ([score[i, j - 1] - 5] if j else []))
        return score[len(a), len(b)]

    for x in align.align(spark.createDataFrame(rows, "k int, a array<string>, b array<string>")).collect():
        total = sum(align.similarity(x.a[p.i], x.b[p.j]) for p in x.pairs) - 5 * (len(x.a) + len(x.b) - 2 * len(x.pairs))
        assert total == best(x.a, x.b)
    one = spark.createDataFrame([(a, b) for _, p, q in rows for a, b in zip(p, q)] + [("the big cat", "cat the small"), ("x", ""), ("", "")], "a string, b string")
    assert all(r.s == align.similarity(r.a, r.b) for r in one.withColumn("s", align.similarity_of(F.col("a"), F.col("b"))).collect())


def test_error_rate(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, [], ["x"])], "k int, reference array<string>, found array<string>")
    assert [(r.k, r.errors, r.n, r.rate) for r in align.error_rate(df).orderBy("k").collect()] == [(1, 1, 2, 0.5), (2, 1, 0, None)]


def test_order_of_classes():
    assert annotations.topological([("b", "c"), ("a", "c"), ("c", "d")]) == (["a", "b", "c", "d"], [])
    assert annotations.topological([("a", "b"), ("b", "a"), ("x", "y")]) == (["x", "y"], ["a", "b"])


def test_changes_and_long_keys(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "x", "y", None], ["x", "z", None, None]))
    assert sorted((r.change, r.k, r.times) for r in sets.changes(a, b).where("k is not null").collect()) == [("added", "z", 1), ("removed", "x", 1), ("removed", "y", 1)]
    assert [(r.change, r.times) for r in sets.changes(a, b).where("k is null").collect()] == [("added", 1)]
    key = "IMDI_" + "k" * 3000
    assert metadata.record(spark.createDataFrame([("f", 1, f"{key}:\tv")], "file string, line int, text string")).first().imdi[0].key == key[5:]


def test_files(spark, tmp_path):
    for name, n in (("a.cha", 10), ("b.CHA", 10), ("sub/c.cha", 2_000_000), ("sub/0phonx/d.cha", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    stem = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    every = transcripts.files(spark, str(tmp_path), "*.cha")
    assert stem(every) == ["a.cha", "c.cha", "d.cha"] and stem(transcripts.files(spark, str(tmp_path), "*.cha", recursive=False)) == ["a.cha"]
    assert stem(transcripts.files(spark, str(tmp_path / "b.CHA"))) == ["b.CHA"] and stem(transcripts.corpora(every)) == ["a.cha", "c.cha"]
    assert stem(transcripts.large(every, 1)) == ["c.cha"]
    assert stem(transcripts.unchanged_since(every, F.current_timestamp())) == stem(every) and not stem(transcripts.unchanged_since(every, F.lit("2000-01-01").cast("timestamp")))


def test_underlines_against_a_stack(spark):
    r = random.Random(4)
    b, e = transcripts.UNDERLINE
    texts = ["".join(r.choice((b, e, "x", "yz")) for _ in range(r.randrange(14))) for _ in range(60)]

    def plain(t):
        parts, at, stack, gone = [], 0, [], set()
        while at < len(t):
            m = t[at : at + 2]
            parts.append(m if m in (b, e) else t[at])
            at += len(parts[-1])
        for i, p in enumerate(parts):
            if p == b:
                stack.append(i)
            elif p == e and stack:
                stack.pop()
            elif p == e:
                gone.add(i)
        return "".join(p for i, p in enumerate(parts) if i not in gone | set(stack)), len(stack), len(gone)

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", transcripts.underlined(F.col("t")).alias("u")).orderBy("i").collect()
    assert [(x.u.text, x.u.begins, x.u.ends) for x in got] == [plain(t) for t in texts]


def test_one_speaker(spark):
    text = "@Begin\n@Participants:\tANN Child, BOB Father\n@ID:\teng|c|ANN|||\n@ID:\teng|c|BOB|||\n*ANN:\ta\n%com:\tx\n*BOB:\tb\n@End"
    raw = raws(spark, text)
    t = transcripts.tiers(raw).join(raw, ["file", "line"])
    got = transcripts.one_speaker(t, spark.createDataFrame([("f0", "ANN"), ("f0", "BOB")], "file string, code string"))
    one = lambda c: [r.raw for r in got.where(F.col("code") == c).orderBy("line").collect()]
    assert one("ANN") == ["@Begin", "@Participants:\tANN Child", "@ID:\teng|c|ANN|||", "*ANN:\ta", "%com:\tx", "@End"]
    assert one("BOB") == ["@Begin", "@Participants:\tBOB Father", "@ID:\teng|c|BOB|||", "*BOB:\tb", "@End"]


def test_new_files_are_validated_once(spark, tmp_path):
    from loomspan.operators import validation

    schema = "file string, line int, speaker string, start_ms long, end_ms long"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        jobs.validated(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", schema, validation.backwards).awaitTermination()
        return sorted((r.file, r.line, r.code, r.batch) for r in spark.read.schema("file string, line int, code string, batch int").parquet(f"{tmp_path}/out").collect())

    add([("a", 1, "A", 10, 20), ("a", 2, "A", 5, 30)])
    assert run() == [("a", 2, "E701", 0)] == run()
    add([("b", 1, "A", 10, 9)])
    assert run() == [("a", 2, "E701", 0), ("b", 1, "E362", 1)]
