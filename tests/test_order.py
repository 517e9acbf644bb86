"""The order of classes against the rules it comes from."""

import random

from loomspan.operators import annotations


def test_order_keeps_the_rules_and_leaves_cycles_out():
    rng = random.Random(8)
    for _ in range(40):
        rules = [(rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH")) for _ in range(rng.randint(0, 12))]
        out, rest = annotations.topological(rules)
        names = {x for r in rules for x in r}
        assert sorted(out + rest) == sorted(names)
        place = {n: i for i, n in enumerate(out)}
        for i, n in enumerate(out):
            assert all(place[a] < i for a, b in rules if b == n)
            free = [m for m in names if m not in out[:i] and all(a in out[:i] for a, b in rules if b == m)]
            assert n == min(free)
        # what is left waits for something that is left
        assert all(any(b == n and a in rest for a, b in rules) for n in rest)


def test_order_of_a_table(spark):
    pairs = spark.createDataFrame([("B", "A")] * 30 + [("A", "B")] * 2 + [("A", "C")] * 25 + [("C", "A")] * 20 + [("A", "D")] * 21 + [("E", "D")] * 5, "a string, b string")
    assert sorted(map(tuple, annotations.ordering(pairs).collect())) == [(0, "B"), (1, "A"), (2, "D")]
