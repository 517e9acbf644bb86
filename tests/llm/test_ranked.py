"""Ranked search by block-max pruning against scores computed for every document."""

import math
import random
import re
from collections import Counter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(w), len(w)) for d, w in ((d, terms_of(t)) for d, t in docs) if w]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag, size in bags:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms_of(text)) if bag[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k])]
    return out


def key(row):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in row)


def sample(n=400, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    pick = lambda m: " ".join(vocabulary[min(299, int(rng.expovariate(0.03)))] for _ in range(m))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(n)]
    docs += [(900 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(3, docs[3][1]), (None, docs[3][1]), (None, "W1 w1 É9é"), (950, None), (951, ""), (952, "!?"), (953, "w5 " * 30_000)]
    items = [(f"i{i}", pick(rng.randint(1, 12))) for i in range(12)] + [("a", docs[3][1]), ("b", "É9é, W1!"), ("c", None), ("d", "…"), ("e", "nowhere"), (None, "w2 w3")]
    return docs, items


def test_search_is_exact_whatever_the_blocks(spark):
    from loomspan.llm import ranked

    docs, items = sample()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id string, text string, doc_id int")
    for k, seeds, words in ((5, 2, 1 << 16), (50, 1, 20), (1000, 4, 1 << 16)):
        got = [tuple(r) for r in ranked.search(table, asked, k, seeds, words).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items, k), key=key)


def test_blocks_below_the_bound_are_not_scored(spark, monkeypatch):
    """In one task and many small blocks: the few blocks that hold the asked words are read, the result is that of all of them."""
    from loomspan.llm import ranked

    docs = [(i, f"common word number{i % 7} " + ("rare gem " if i in (500, 900) else "")) for i in range(1000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    n, total = ranked.corpus_size(table)
    assert (n, total) == (1000, sum(len(t.split()) for _, t in docs))
    index = ranked.build_index(table.coalesce(1), n, total, 512).collect()
    asked = ranked.Asked(["rare gem common"])
    asked.weigh({i: sum(t in x.split() for _, x in docs) for i, t in enumerate(sorted(["rare", "gem", "common"], key=lambda t: int(ranked.words(t.encode(), ranked.ALNUM)[0][0])))}, n)
    best, scored = ranked.Best(2, 1), 0
    import numpy as np

    places = [asked.in_block(np.frombuffer(r.terms, np.uint64)) for r in index]
    bounds = np.array([asked.bounds(p, np.frombuffer(r.maxima, np.uint32))[0] for p, r in zip(places, index, strict=True)])
    for j in np.argsort(-bounds, kind="stable").tolist():
        if bounds[j] < best.floor:
            break
        block = ranked.Block(index[j].asDict(), asked, places[j], n, total)
        scores = block.scores(asked, 0)
        assert scores.max() <= bounds[j]
        best.add(scores, block)
        scored += 1
    assert scored <= 3 < len(index)
    assert sorted(best.rows[:, 2].tolist()) == [500, 900]


def test_empty_tables(spark):
    from loomspan.llm import ranked

    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert ranked.search(docs.where("false"), items).collect() == []
    assert ranked.search(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in ranked.search(docs, items).collect()] == [("i", 1, 1)]
