"""Near duplicates in large buckets of different classes: exact prefixes of rare shingles."""

from collections import Counter, defaultdict

import numpy as np


def pages(rng, n, shared=95, own=(4, 40)):
    """Pages of one template, each with own words; those with few own words are near copies of each other."""
    base = [f"t{i}" for i in range(shared)]
    return [(d, " ".join(base[:50] + [f"o{x}" for x in rng.integers(0, 10**6, int(rng.integers(*own)))] + base[50:] + ["ha"] * int(rng.integers(0, 4)))) for d in range(n)]


def bags(rows):
    out = []
    for _, t in rows:
        w = t.split()
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    return out


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_alike_texts_share_a_rare_shingle(spark):
    from loomspan.llm.neardup import rare_groups, shingle_sets, sketch

    rows = pages(np.random.default_rng(3), 120, own=(2, 30))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tid = {r.doc_id: bytes(r.tid) for r in sketch(docs).collect()}
    mixed = spark.createDataFrame([(t, t) for t in set(tid.values())], "tid binary, root binary")
    groups = defaultdict(dict)
    for r in rare_groups(mixed, shingle_sets(docs, docs), 0.8).collect():
        groups[r.bucket][bytes(r.tid)] = r.lead
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b and (g[a] or g[b])}
    sets = bags(rows)
    alike = {tuple(sorted((tid[i], tid[j]))) for i in range(120) for j in range(i) if tid[i] != tid[j] and similarity(sets[i], sets[j]) >= 0.8}
    assert len(alike) > 200 and alike <= met
    # far fewer than all pairs, though all pages share the template
    assert len(met) < 0.6 * 120 * 119 / 2


def test_template_pages_are_told_apart_and_near_copies_found(spark):
    """2,000 pages of a template that are not alike, and 500 near copies of some of them: all of these are found, no other."""
    from loomspan.llm.neardup import near_duplicates

    rng = np.random.default_rng(5)
    rows = pages(rng, 2000, own=(25, 40))
    for i in range(500):
        w = rows[i * 3][1].split()
        w[int(rng.integers(len(w)))] = "changed"
        rows.append((10_000 + i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_class) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, found = bags(rows), 0
    for i in range(500):
        if similarity(sets[i * 3], sets[2000 + i]) >= 0.8:
            found += 1
            assert got[10_000 + i] == got[i * 3] == (i * 3, 2)
    assert found > 450
    assert all(got[d] == (d, 1) for d in range(2000) if d % 3 or d >= 1500)
