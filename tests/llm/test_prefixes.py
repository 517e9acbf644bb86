"""The prefix trie against one built from dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].add(c)
        ends[tuple(built)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def made(seed=2, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.randint(0, 1 + t)} " * (t + 1)))
    rows += [(1000 + c, t, "user", f"hot {t}") for c in range(0, 400, 20) for t in range(5)]  # equal conversations with bases of their own
    rows += [(2000, t, "user", f"long {t}") for t in range(300)] + [(2020, t, "user", f"long {t}") for t in range(250)]
    rows += [(3000, None, None, None), (3000, 1, "", ""), (3000, 1, "a", "bc"), (3000, 1, "ab", "c"), (3000, 2, "x", "y"), (3000, 2, "x", "y"), (None, 1, "user", "lost"), (3021, 0, "user", "no base")]
    return rows


def check(spark, rows, parts):
    from loomspan.llm import prefixes

    table = spark.createDataFrame([(*r, 9, "q") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixes.conversation_trie(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == brute(rows)


def test_trie_over_few_and_many_partitions(spark):
    for parts in (1, 3, 40):
        check(spark, made(), parts)


def test_runs_longer_than_a_piece_cross_partitions(spark, monkeypatch):
    """Equal conversations fill whole partitions; their ids come in several pieces from each."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 20 * 900, 20) for t in range(3)] + [(c, 0, "user", f"single {c % 3}") for c in range(20, 9000, 60)]
    check(spark, rows, 7)


def test_sweep_and_stitch_at_every_cut():
    """Any cut of the sorted keys into partitions gives the same nodes, with pieces of three ids."""
    from loomspan.llm import prefixes

    rng, keys = random.Random(1), []
    for c in range(40):
        keys.append((b"".join(bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 4))), c))
    keys = [(k, c, [1] * (len(k) // 16)) for k, c in sorted(keys + [(keys[0][0], 100 + i) for i in range(9)])]
    piece, prefixes.PIECE = prefixes.PIECE, 3
    try:
        seen = set()
        for cuts in [(), *((a,) for a in range(1, len(keys))), (5, 6, 7, 8, 30), (3, 20, 21, 40), tuple(range(1, len(keys)))]:
            records = []
            for part, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(keys)), strict=True)):
                records += prefixes.Sweep(part).rows((c, k, t) for k, c, t in keys[a:b])
            opened = sorted((r for r in records if r[0] == prefixes.OPEN), key=lambda r: r[1:5])
            stitched = list(prefixes.Stitch().rows((*r[1:7], *r[8:]) for r in opened))
            done = [(r[3], r[6], r[8], r[9], r[10], r[11], r[13] or prefixes.EMPTY) for r in records if r[0] != prefixes.OPEN] + [(r[3], *r[6:]) for r in stitched]
            seen.add(tuple(sorted(done)))
        assert len(seen) == 1
    finally:
        prefixes.PIECE = piece


def test_empty_table(spark):
    from loomspan.llm import prefixes

    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.conversation_trie(none).collect() == []
