"""What must not be worked out again for each part of a row, each filter on it or each round."""

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import brackets, content, graph, metadata
from loomspan.plans import transcripts as _transcripts  # noqa: F401  registers the queries
from loomspan.plans.registry import QUERIES
from loomspan.sources import transcripts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_split_once_and_layouts_take_no_join(spark):
    raw = spark.createDataFrame([("f", 1, "0.0 1.0\tA:\tx"), ("f", 2, "1.0 2.0 B:\ty\tz"), ("g", 1, "1.0\t2.0\tB:\ty\tz")], "file string, line int, raw string")
    out = transcripts.kept(transcripts.parsed(raw))
    assert "Join" not in plan(out) and plan(out).count("\t, 4)") == 1
    assert [(r.file, r.line, r.layout, r.speaker, r.content) for r in out.orderBy("file", "line").collect()] == [("f", 1, "A", "A", "x"), ("f", 2, "A", None, "z"), ("g", 1, "B", "B", "y\tz")]


def test_starts_of_elements_fit_their_expressions(spark):
    """An element is found whichever of its forms it has."""
    text = "x [2y] ((c)) <<KN>> <<MA <X @b X> MA>> .. ... ...(.5) -- (H)= (H) (Hx) (TSK) (COUGH) @@@ @ /f/ & + % ? . ,"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(content.elements(F.col("t"))).alias("e")).select("e.kind").collect()
    assert {r.kind for r in got} == {k for k, _ in content.ELEMENTS if k != "Space"} | {"Word"}


def test_brackets_are_found_once_a_line(spark, sf):
    assert plan(QUERIES["scf01_brackets"](spark, sf)).count("[\\s\\S]") == 1
    n = 3000
    text = "a[2b]((c ["
    many = spark.createDataFrame([("[x] " * n,), (text,), (None,)], "t string").select(brackets.tokens(F.col("t")).alias("b")).collect()
    assert [(x.char_offset, x.kind) for x in many[0].b] == [(4 * i + d, k) for i in range(n) for d, k in ((0, "Open"), (2, "Close"))]
    assert [tuple(x) for x in many[1].b] == [(1, "Open", 2), (4, "Close", None)] and many[2].b == []


def test_a_record_gathers_its_lines_once(spark):
    rows = spark.createDataFrame([("f", 3, "Title:\tb"), ("f", 2, "Title:\ta"), ("f", 4, "DOI:\tdoi:10.1/x"), ("f", 5, "DOI:\t10.2/y"), ("f", 6, "Creator:\tC"), ("f", 1, "Creator:\tD"), ("f", 7, "IMDI_k:\tv"), ("g", 1, "Other:\tx")], "file string, line int, text string")
    r = metadata.record(rows)
    assert plan(r).count("collect_list") == 2
    f, g = r.orderBy("file").collect()
    assert (f.title, f.doi, f.creators, [tuple(x) for x in f.imdi], f.date) == ("a", "10.2/y", ["D", "C"], [("k", "v")], None)
    assert (g.file, g.title, g.creators, g.doi) == ("g", None, [], None)


def test_components_within_files_need_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = [(int(f), int(a), int(a + rng.integers(0, 4))) for f, a in zip(rng.integers(0, 9, 600), rng.integers(0, 200, 600), strict=True)] + [(99, i, i + 1) for i in range(400)]

    def want():
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for f, a, b in (x for x in links if x[1] != x[2]):
            x, y = sorted((find((f, a)), find((f, b))))
            root[y] = x
        return {x: find(x)[1] for x in list(root)}

    df = spark.createDataFrame(links, "file long, a int, b int")
    read = lambda out: sorted((r.file, r.node, r.root) for r in out.collect())
    expected = sorted((f, n, r) for (f, n), r in want().items())
    # files of more links than a task holds go on to the rounds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert read(graph.components_by_file(df, held=50)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(graph, "components", None)
    assert read(graph.components_by_file(df)) == expected
