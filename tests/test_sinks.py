"""What is written, read back; edits and rules on small rows."""

from pyspark.sql import functions as F

from loomspan import sinks
from loomspan.operators import align, transforms, validation


def test_files_read_back(spark, tmp_path):
    docs = spark.createDataFrame([("a", "@Begin\n*A:\tx\n@End\n"), ("b", "one\ttwo\n")], "file string, text string")
    sinks.documents(docs, f"{tmp_path}/docs")
    back = spark.read.text(f"{tmp_path}/docs", wholetext=True).collect()
    assert {r.file: r.value for r in back} == {r.file: r.text for r in docs.collect()}
    table = spark.createDataFrame([("a", 1, None), ("b", 2, "x\ty")], "file string, n int, note string")
    sinks.tsv(table, f"{tmp_path}/table")
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/table")
    assert back.columns == ["file", "n", "note"] and sorted(map(tuple, back.collect())) == [("a", "1", None), ("b", "2", "x\ty")]
    files = spark.createDataFrame([("c1", "c1/x"), ("c1", "c1/y"), ("c2", "c2/z")], "collection string, path string")
    sinks.file_lists(files, f"{tmp_path}/lists")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lists/all").collect()) == ["c1/x", "c1/y", "c2/z"]
    assert sorted(map(tuple, spark.read.text(f"{tmp_path}/lists/by-collection").select("collection", "value").collect())) == [("c1", "c1/x"), ("c1", "c1/y"), ("c2", "c2/z")]


def test_batches(spark, tmp_path):
    rows = spark.createDataFrame([("t", "e", str(i % 2), f"k{i}", i) for i in range(500)], "task string, engine string, version string, key string, value int")
    folder = str(tmp_path)

    def put(group, items):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(f"{group[2]} {k} {v}" for k, v in items))

    sinks.put_batches(rows, put, 40)
    batches = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert all(len(b) <= 40 and len({x.split()[0] for x in b}) == 1 for b in batches)
    assert sorted(x for b in batches for x in b) == sorted(f"{i % 2} k{i} {i}" for i in range(500))


def test_rows_of_a_report_escape_bars(spark):
    t = spark.createDataFrame([("a|b", 2), (None, 1)], "k string, n int")
    assert [r.text for r in sinks.markdown_report(t, "T", "n").orderBy("nth").collect()] == ["# T", "", "| k | n |", "|-|-|", "|  | 1 |", "| a\\|b | 2 |"]


def test_steps_between_two_lists(spark):
    rows = spark.createDataFrame([(1, ["the", "cat", "sat"], ["cat", "sat", "down"]), (2, [], ["x"]), (3, ["x"], []), (4, ["a"], ["a"])], "k int, a array<string>, b array<string>")
    got = {r.k: [(s.kind, s.word) for s in r.steps] for r in transforms.compared(align.align(rows)).collect()}
    assert got[1] == [("delete", "the"), ("match", "cat"), ("match", "sat"), ("insert", "down")]
    assert got[2] == [("insert", "x")] and got[3] == [("delete", "x")] and got[4] == [("match", "a")]


def test_graphs(spark):
    rows = [(1, ["1|0|R", "2|1|X"]), (2, ["1|2|X", "2|1|X"]), (3, ["1|0|R", "2|0|R"]), (4, ["1|0|R", "2|3|X", "3|2|X"]), (5, []), (6, None), (7, [f"{i}|{i - 1}|X" for i in range(1, 900)]), (8, [f"{i}|{i % 900 + 1}|X" for i in range(1, 901)])]
    got = validation.graph(spark.createDataFrame([("f", *r) for r in rows], "file string, line int, gra array<string>")).collect()
    assert sorted((r.line, r.code) for r in got) == [(2, "E722"), (2, "E724"), (3, "E723"), (4, "E724"), (8, "E722"), (8, "E724")]


def test_replacements_are_longest_first(spark):
    got = spark.createDataFrame([("abcab a",), ("",), (None,)], "t string").select(transforms.replaced(F.col("t"), {"a": "1", "ab": "2", "abc": "3", "b": "4"})).collect()
    assert [r[0] for r in got] == ["32 1", "", None]


def test_tiers_and_roles(spark):
    t = spark.createDataFrame([("f", 1, "com", 3, "b"), ("f", 1, "com", 2, "a"), ("f", 1, "act", 4, "c"), ("f", 9, "com", 10, "d")], "file string, main int, name string, line int, text string")
    assert sorted((r.main, r.name, r.line, r.text) for r in transforms.combined(t).collect()) == [(1, "act", 4, "c"), (1, "com", 2, "a b"), (9, "com", 10, "d")]
    p = transforms.with_roles(spark.createDataFrame([("A", "Child"), ("B", "Child")], "code string, role string"), {"B": "Mother"})
    assert [r.role for r in p.orderBy("code").collect()] == ["Child", "Mother"]


def test_events_order(spark):
    rows = spark.createDataFrame([("f", 1, "A", "x &*B:one <y &*C:two_2> [/] z &*D:three ."), ("f", 2, "A", "none .")], "file string, idx int, speaker string, text string")
    got = [(r.idx, r.nth, r.speaker, r.text) for r in transforms.events(rows).orderBy("idx", "nth").collect()]
    assert got == [(1, 0, "A", "x <y > [/] z ."), (1, 1, "C", "two 2 ."), (1, 2, "B", "one ."), (1, 3, "D", "three ."), (2, 0, "A", "none .")]
