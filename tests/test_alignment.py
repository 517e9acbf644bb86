"""Alignment against plain dynamic programming, and anchored alignment against what was done to the words."""

import random

import numpy as np
import pytest

from loomspan.operators import align, transforms
from loomspan.plans import aligned  # noqa: F401  registers the queries
from loomspan.plans.registry import QUERIES


def brute(a, b, score, gap=-5):
    m, n = len(a), len(b)
    best = [[(i + j) * gap if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    way = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            pair, up, left = best[i - 1][j - 1] + score(a[i - 1], b[j - 1]), best[i - 1][j] + gap, best[i][j - 1] + gap
            best[i][j], way[i][j] = max(pair, up, left), 0 if pair >= up and pair >= left else 1 if up >= left else 2
    out, i, j = [], m, n
    while i and j:
        k = way[i][j]
        if k == 0 and score(a[i - 1], b[j - 1]) > 0:
            out.append((i - 1, j - 1))
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1]


@pytest.mark.parametrize("cells", [64, 1 << 12, 1 << 24])
@pytest.mark.parametrize("score", [align.similarity, align.exact])
def test_alignment_is_plain_dynamic_programming(monkeypatch, cells, score):
    """Whether pairs go in batches or alone, with moves worked out again stretch by stretch."""
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(1)
    voc = ["a", "ab", "abc", "b", "c d", "d", "", "c", "e f g"]
    xs, ys = ([[rng.choice(voc) for _ in range(rng.randint(0, 14))] for _ in range(200)] for _ in range(2))
    assert align.align_lists(xs, ys, score) == [brute(x, y, score) for x, y in zip(xs, ys, strict=True)]


def test_long_pair_in_little_memory():
    rng = random.Random(2)
    x = [f"w{rng.randint(0, 900)}" for _ in range(5000)]
    y = [w for w in x if rng.random() > 0.1]
    pairs = align.aligned(x, y, align.exact)
    assert len(pairs) == len(y) and all(x[i] == y[j] for i, j in pairs)


def rises(pairs):
    return all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_chain_is_a_longest_one(spark):
    rng, rows = random.Random(3), []
    for f in range(6):
        js = list(range(12))
        rng.shuffle(js)
        rows += [(f, i, j) for i, j in enumerate(js)]
    got = align.chain(spark.createDataFrame(rows, "file long, i long, j long")).collect()
    for f in range(6):
        points = [(i, j) for g, i, j in rows if g == f]
        longest = [1] * 12
        for k in range(12):
            longest[k] = 1 + max((longest[q] for q in range(k) if points[q][1] < points[k][1]), default=0)
        mine = sorted((r.i, r.j) for r in got if r.file == f)
        assert len(mine) == max(longest) and rises(mine) and set(mine) <= set(points)


def test_anchored_alignment(spark):
    """Words that were lost, changed, put in, doubled and moved: pairs are of equal words, rise in both, and miss little of the best."""
    rng, xs, ys = random.Random(4), {}, {}
    for f in range(12):
        x = [f"w{rng.randint(0, 60 + 40 * f)}" for _ in range(rng.choice([0, 3, 80, 300]))]
        y = [w for w in x if rng.random() > 0.08]
        for _ in range(len(y) // 12):
            y.insert(rng.randrange(len(y)), "um")
        if f == 7 and len(y) > 100:
            y = y[60:] + y[:60]
        xs[f], ys[f] = x, y
    table = lambda d: spark.createDataFrame([(f, p, w) for f, ws in d.items() for p, w in enumerate(ws)], "file long, pos long, word string")
    got = align.anchored(table(xs), table(ys)).collect()
    assert got
    for f in xs:
        mine = sorted((r.i, r.j) for r in got if r.file == f)
        assert rises(mine) and all(xs[f][i] == ys[f][j] for i, j in mine)
        assert len(mine) >= 0.95 * len(brute(xs[f], ys[f], align.exact)) or f == 7


def test_times_come_back(spark):
    words = [f"v{i}" for i in range(50)]
    w = spark.createDataFrame([(1, i, x) for i, x in enumerate(words)] + [(2, 0, "alone")], "file long, pos long, word string")
    t = spark.createDataFrame([(1, k, words[i], i * 400) for k, i in enumerate(i for i in range(50) if i % 10 != 4)], "file long, pos long, word string, start_ms long")
    got = {(r.file, r.pos): (r.start_ms, r.word_end) for r in align.recovered(w, t).collect()}
    assert got[1, 4] == (None, None) and got[2, 0] == (None, None)
    assert got[1, 3] == (1200, 2000) and got[1, 49] == (19600, 20100) and sum(s is not None for s, _ in got.values()) == 45
    assert align.recovered(w.where("false"), t).collect() == []


def test_matches_and_accuracy(spark):
    p = spark.createDataFrame([(1, "a b c".split(), "a x c d".split()), (2, [], ["a"]), (3, ["a"], [])], "k int, reference array<string>, found array<string>")
    got = {r.k: (r.matches, r.deletions, r.insertions, r.accuracy) for r in align.agreement(p).collect()}
    assert got == {1: (2, 1, 2, 2 / 3), 2: (0, 0, 1, None), 3: (0, 1, 0, 0.0)}


def test_single_words_are_scored_by_their_pieces():
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"abc" * 400})
    table = align.Scores(texts, align.similarity)
    assert table.like is not None
    every = np.arange(len(texts))[None]
    assert table.grid(every, every)[0].tolist() == [[align.similarity(a, b) for b in texts] for a in texts]
    xs, ys = ([[rng.choice(texts) for _ in range(rng.randint(0, 30))] for _ in range(60)] for _ in range(2))
    assert align.align_lists(xs, ys) == [brute(x, y, align.similarity) for x, y in zip(xs, ys, strict=True)]


def test_word_errors_don_t_grow_with_the_words_of_a_pair_to_the_third(spark):
    """Edit distances of batches of any sizes are those of plain dynamic programming, and the plan spells no word by its place among all."""
    rng, rows = random.Random(8), []
    for k in range(120):
        rows.append((k, *([rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(2))))
    df = spark.createDataFrame([*rows, (-1, None, ["a"])], "k int, reference array<string>, found array<string>")
    out = align.error_rate(df)
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()

    def distance(a, b):
        best = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, best[0] = best[0], i + 1
            for j, y in enumerate(b):
                last, best[j + 1] = best[j + 1], min(best[j + 1] + 1, best[j] + 1, last + (x != y))
        return best[-1]

    assert {r.k: r.errors for r in out.collect()} == {k: distance(a, b) for k, a, b in rows} | {-1: None}


def test_steps_align_once(spark):
    p = spark.createDataFrame([(1, ["a", "b"], ["b", "c"])], "k int, a array<string>, b array<string>")
    out = transforms.compared(align.align(p, least=1)).selectExpr("k", "inline(steps)")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.kind, r.word) for r in out.collect()] == [("delete", "a"), ("match", "b"), ("insert", "c")]


def test_documents_are_aligned_where_they_are_read(spark, sf):
    """Words don't cross the network one by one: the only exchange is that of the counts."""
    assert QUERIES["nlp01_align"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    out = QUERIES["nlp01_align"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert out.count("Exchange") == 1 and out.count("ArrowEvalPython") == 1
