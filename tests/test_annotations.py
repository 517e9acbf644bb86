"""Annotation files whose references are long, lead nowhere or run in a circle."""

from loomspan.sources import annotations


def document(refs, slots='<TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="10"/><TIME_SLOT TIME_SLOT_ID="t2"/>'):
    base = '<TIER TIER_ID="base"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>x</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>'
    more = "".join(f'<ANNOTATION><REF_ANNOTATION ANNOTATION_ID="{i}" ANNOTATION_REF="{to}"><ANNOTATION_VALUE/></REF_ANNOTATION></ANNOTATION>' for i, to in refs)
    return f'<ANNOTATION_DOCUMENT><TIME_ORDER>{slots}</TIME_ORDER>{base}<TIER TIER_ID="more" PARTICIPANT="P">{more}</TIER></ANNOTATION_DOCUMENT>'


def test_references_are_followed_to_the_end(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else "a") for k in range(20)]
    odd = [("lost", "nowhere"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("self", "self"), ("into", "r1")]
    files = [(1, document(chain)), (2, document(odd)), (3, "<broken"), (4, None), (5, document([]))]
    got = {(r.file, r.id): (r.depth, r.start_ms, r.end_ms, r.speaker) for r in annotations.elan(spark.createDataFrame(files, "file int, text string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "a"): (0, 10, None, None)} | {(1, f"c{k}"): (k + 1, 10, None, "P") for k in range(20)}
    assert {i: v[:3] for (f, i), v in got.items() if f == 2} == {"a": (0, 10, None)} | {i: (None, None, None) for i, _ in odd}
    assert {k for k in got if k[0] > 2} == {(5, "a")}


def test_references_need_no_join(spark):
    """A file is read once, and what refers to what is settled in it; a name that occurs twice means the first."""
    files = spark.createDataFrame([(1, document([("b", "a"), ("b", "nowhere"), ("c", "b")])), (2, document([("c", "b")])), (3, "<ANNOTATION_DOCUMENT/>")], "file int, text string")
    out = annotations.elan(files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("from_xml") == 1
    assert sorted((r.file, r.id, r.depth, r.start_ms, r.text) for r in out.collect() if r.depth is not None) == [(1, "a", 0, 10, "x"), (1, "b", 1, 10, ""), (1, "c", 2, 10, ""), (2, "a", 0, 10, "x")]
    assert sorted((r.file, r.id) for r in out.collect() if r.depth is None) == [(1, "b"), (2, "c")]
