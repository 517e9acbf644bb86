"""Operators that SQL cannot express, against brute force on small inputs with nulls, ties, repeats and empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counts(text, n=5):
    w = WORD.findall(lowered(text))
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def made(seed=3, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(n):
        if i % 3 and texts:
            w = list(texts[rng.integers(len(texts))])
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = "x" + str(rng.integers(1000))
        else:
            w = [vocabulary[int(x)] for x in rng.integers(0, 400, rng.integers(40, 200))]
        texts.append(w)
        rows.append((i, " ".join(w)))
    return rows + [(100, None), (101, ""), (102, "!!"), (103, "A b"), (104, "a, B"), (105, "ha " * 300), (None, "one two three four five six"), (106, "ha " * 300), (107, rows[0][1])]


def test_near_duplicates(spark):
    from loomspan.llm.neardup import near_duplicates

    rows = made()
    got = near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")).collect()
    sets = [counts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(find(i), []).append(d)
    size = {d: len(members) for members in want.values() for d in members}
    first = {d: min(members, key=lambda x: -1 if x is None else x) for members in want.values() for d in members}
    assert {r.doc_id: (r.class_id, r.n_class) for r in got} == {d: (first[d], size[d]) for d, _ in rows}
    assert sum(r.is_kept for r in got) == len(want)
    # the same where all buckets of three and more are larger ones
    again = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()
    assert {r.doc_id: (r.class_id, r.n_class) for r in again} == {d: (first[d], size[d]) for d, _ in rows}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_weighted_jaccard():
    from loomspan.llm.neardup import shingles, signatures

    rng = np.random.default_rng(1)
    a = [f"t{i}" for i in rng.integers(0, 60, 400)]
    b = a[:330] + [f"u{i}" for i in range(70)]
    owner, s, w, _ = shingles([" ".join(a).encode(), " ".join(b).encode()])
    sig = signatures(owner, s, w, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - similarity(counts(" ".join(a)), counts(" ".join(b)))) < 0.03


def classes_of(rows):
    """Smallest doc_id and size of each row's class, by comparing all pairs."""
    sets = [counts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    own = [find(i) for i in range(len(rows))]
    first, size = {}, Counter(own)
    for i, (d, _) in enumerate(rows):
        first[own[i]] = min(first.get(own[i], d), d)
    return {d: (first[k], size[k]) for (d, _), k in zip(rows, own, strict=True)}


def test_near_duplicates_of_very_long_and_many_equal_texts(spark):
    from loomspan.llm.neardup import near_duplicates

    words = [f"w{i % 4999}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1000], "new", *words[1000:]])), (3, " ".join(f"v{i % 4999}" for i in range(200_000)))] + [(10 + i, "the same text again and again") for i in range(3000)]
    frame = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, tid binary, root int")
    got = {r.doc_id: (r.class_id, r.n_class) for r in near_duplicates(frame).collect()}
    assert got[1] == got[2] == (1, 2) and got[3] == (3, 1) and all(got[10 + i] == (10, 3000) for i in range(3000))


def test_near_copies_about_the_threshold(spark):
    """Hundreds of copies of one text, most pairs of which are somewhat less alike than the threshold."""
    from loomspan.llm.neardup import near_duplicates

    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = []
    for d in range(500):
        w = list(base)
        for at in rng.choice(400, int(rng.integers(4, 18)), replace=False):
            w[int(at)] = f"x{rng.integers(10**6)}"
        rows.append((d, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes_of(rows)
    assert 1 < len({c for c, _ in want.values()}) < 500
    assert {r.doc_id: (r.class_id, r.n_class) for r in got} == want


def _bucket(spark, rng, n, edits):
    from loomspan.llm.neardup import _bytes16, sketch

    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(*edits)), replace=False):
            w[int(at)] = f"x{rng.integers(10**6)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = sketch(docs).collect()
    return docs, {r.doc_id: r for r in signed}, rows, _bytes16


def test_larger_buckets_are_compared_whole(spark):
    from loomspan.llm.neardup import COORDINATES, joining, meeting, shingle_sets, sketch

    docs, by, rows, _ = _bucket(spark, np.random.default_rng(2), 120, (1, 9))
    n = len(rows)
    brief = np.stack([np.frombuffer(by[d].brief, np.uint8) for d in range(n)])
    band = np.array([by[d].bands for d in range(n)])
    tid = [bytes(by[d].tid) for d in range(n)]
    root = {tid[i]: min(tid[i - 1], tid[i]) for i in range(1, n, 2)} | {tid[i - 1]: min(tid[i - 1], tid[i]) for i in range(1, n, 2)}
    large = [(int(b), tid[d]) for d in range(n) for b in band[d]]
    roots = spark.createDataFrame([(t, r) for t, r in root.items() if t != r], "tid binary, root binary")
    signed = sketch(docs).select("tid", "brief", "bands")
    near = meeting(spark.createDataFrame(large, "bucket long, tid binary"), roots, signed, 0.68, block=25).collect()
    same = (brief[:, None] == brief[None]).mean(axis=2)
    want = set()
    for i in range(n):
        for j in range(i):
            shared = np.flatnonzero(band[i] == band[j])
            if len(shared) and same[i, j] >= 0.68 and root[tid[i]] != root[tid[j]]:
                want |= {(int(band[i][shared[0]]), tid[i]), (int(band[i][shared[0]]), tid[j])}
    assert len(want) > 100 and {(r.bucket, bytes(r.tid)) for r in near} == want and len(near) == len(want)
    # the links join what pairs of 0.8 and more join, and are fewer than the classes of a bucket's two blocks
    sets = shingle_sets(docs, docs.select("doc_id"))
    found = joining(spark.createDataFrame(near, "bucket long, tid binary, root binary"), signed.select("tid", "brief"), sets, 0.8, 0.12, block=20_000).collect()
    exact = [counts(t) for _, t in rows]

    def joined(pairs):
        own = {r: r for r in root.values()}
        for a, b in pairs:
            x, y = own[a], own[b]
            own = {k: x if v == y else v for k, v in own.items()}
        return sorted(sorted(k for k in own if own[k] == v) for v in set(own.values()))

    pairs = [(root[tid[i]], root[tid[j]]) for i in range(n) for j in range(i) if (band[i] == band[j]).any() and similarity(exact[i], exact[j]) >= 0.8]
    assert joined([(bytes(r.a), bytes(r.b)) for r in found]) == joined(pairs) and COORDINATES == len(brief[0])
    assert all(similarity(exact[i], exact[j]) < 1 for i in range(n) for j in range(i))


def test_neighbours(spark):
    from loomspan.llm.neighbours import search

    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    v[300:700] = v[300]
    rows = [(i, [float(np.float32(x)) for x in v[i]], "x") for i in range(1500)] + [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] + [1.0] * 15, "x"), (2060, [None] * 16, "x"), (None, [1.0] * 16, "x")]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), block=128, sample_rows=800).collect()
    x = np.array([r[1] for r in rows[:1500]])
    hits = total = 0
    for q in range(0, 1500, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        s = np.einsum("d,vd->v", x[q], x)
        s[q] = -np.inf
        hits += len({r.vec_id for r in mine} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        total += 20
    assert {r.query_id for r in got} == set(range(0, 1500, 20)) and hits / total >= 0.9
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_few_repeated_and_of_several_lengths(spark):
    """Every query gets all candidates there are, up to k, each row but its own, among the vectors of its length."""
    from loomspan.llm.neighbours import search

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3)], "x") for i in range(15)] + [(0, [1.0, 2.0, 3.0], "x"), (7, [1.0, 0.0, 0.0], "x"), (7, [1.0, 0.0, 0.0], "x"), (20, [1.0, 2.0], "x"), (21, [3.0, 4.0], "x"), (40, [1.0] * 4, "x")]
    want = []
    for i, (q, v, _) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w, _) in enumerate(rows) if j != i and len(w) == len(v))
            want += [(q, n, c, round(-s, 9)) for n, (s, c) in enumerate(near[:20], 1)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), leaves=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    # one of another length throws out no one, and leaves of few rows are widened
    rows = [(i, [float(x) for x in rng.normal(size=2) + 50 * (i % 30)], "x") for i in range(100)] + [(1000, [1.0, 2.0, 3.0], "x")]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), recall=0.01).collect()
    assert Counter(r.query_id for r in got) == {q: 20 for q in range(0, 100, 20)}


def test_neighbours_recall_on_table(spark, sf):
    from loomspan.llm.neighbours import op6_neighbours

    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], np.float64), np.array([r.vec_id for r in e])
    got = op6_neighbours(spark, sf).collect()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def place_of(doc, text):
    """A document's place: doc_id, then Spark's hash of the text."""
    n = xxhash.xxh64((text or "").encode(), seed=42).intdigest() if text is not None else 42
    return -(2**63) if doc is None else doc, n - 2**64 if n >= 2**63 else n


def test_substrings(spark):
    from loomspan.llm.substrings import remove_repeats

    rng = np.random.default_rng(9)
    passage = [" ".join(f"p{k}_{i}" for i in range(70)) for k in range(3)]
    rows = []
    for d in range(50):
        w = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(5, 120))]
        if d % 3 == 0:
            w[3:3] = passage[d % 2].split()[: int(rng.integers(15, 70))]
        if d % 7 == 0:
            w += ["ha"] * int(rng.integers(10, 60))
        rows.append((d * 2, " ".join(w)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (1000, None), (1001, ""), (1002, "\t x \n y\x0bz "), (1003, "ha " * 70), (1004, rows[3][1] + " tail " + rows[3][1]), (None, rows[0][1]), (200, "other " + rows[6][1])]
    got = remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")).collect()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first, own = {}, [place_of(d, t) for d, t in rows]
    for d, w in zip(own, split, strict=True):
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (2**63,)), (*d, i))
    want = []
    for (d, _), here, w in zip(rows, own, split, strict=True):
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (*here, i):
                gone |= set(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_of_rows_without_id_and_long_texts(spark):
    """Many rows without doc_id are one document; each loses what starts later in it, once."""
    from loomspan.llm.substrings import remove_repeats

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"a{k % 7} {passage}") for k in range(60)] + [(None, f"{passage} b{k}") for k in range(5)] + [(4, passage), (5, "w " * 200_000)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lead = min((t for d, t in rows if d is None), key=lambda t: place_of(None, t))
    want = Counter((None, t) if t == lead else (None, t.split()[0] if t[0] == "a" else t.split()[-1]) for d, t in rows if d is None)
    assert Counter((r.doc_id, r.kept) for r in got if r.doc_id is None) == want
    assert [(r.n_words, r.n_removed, r.kept) for r in got if r.doc_id == 4] == [(30, 30, "")]
    assert [(r.n_words, r.n_removed) for r in got if r.doc_id == 5] == [(200_000, 199_999)]


def test_tokens(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from loomspan.llm.tokens import read_shards, write_shards

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello,  World.\nit's A<|endoftext|>b", None, "", "ÉÀ J̌ 12,5 don't ... x", "word " * 5000, "<|ENDOFTEXT|> Ünï\tcode", "the the, The."]
    rows = [(i * 3 % 7, t) for i, t in enumerate(texts)] + [(None, "first"), (3, "again")]
    got = read_shards(write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, image_ids=50)).collect()
    tok = Tokenizer.from_file(path)
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert read_shards(write_shards(spark.createDataFrame([], "doc_id long, text string"), path)).count() == 0


def test_tokens_of_whole_documents(spark, sf):
    """Piece by piece as a whole text at once: all documents of the small table, and texts of odd characters."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from loomspan.llm.tokens import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), encoder(path)[0]
    rng = np.random.default_rng(12)
    odd = list("aAzZ09 \n\t.,;:!?'\"-_()[]<>|@#éÉßİıǅΣςд中日한\u0301\u0308\u200b\u00a0\u2028\u3000\U0001f600") + ["the", "The", "don't", "<|", "|>", "e.g.", "1,000.5", "  "]
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["".join(rng.choice(odd, int(rng.integers(1, 60)))) for _ in range(3000)]
    crc = lambda data: zlib.crc32(data)
    wrong = [t for t in texts if crc(encode(t.encode())) != crc(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes())]
    assert not wrong, wrong[:5]


def test_packing():
    from loomspan.llm.tokens import Image, pack, to_image, unpack

    rng = np.random.default_rng(0)
    for bits in (1, 5, 8, 16, 17, 31):
        v = rng.integers(0, 2**bits, 40_000).astype(np.uint32)
        assert (unpack(pack(v, bits), len(v), bits) == v).all()
        image = Image(to_image([1, None], [30_000, 10_000], v, bits))
        assert (image.ids(16_000, 33_001) == v[16_000:33_001]).all() and image.doc_ids == [1, None] and image.starts.tolist() == [0, 30_000, 40_000]


def ngrams(text):
    """Counts of the 1- to 3-grams of the padded words of a text."""
    out = Counter()
    for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split():
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return out


def by_count(c, k):
    # a blank is outside of every alphabet and sorts first; shorter n-grams come before longer ones
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), [0 if y == " " else ord(y) for y in x[0]]))[:k]]


def guess(text, profiles, top=300):
    mine = by_count(ngrams(text), top)
    if not mine or not profiles:
        return "und", 0.0
    lack = max(len(p) for p in profiles.values())
    far = sorted((sum(abs(p.index(g) - i) if g in p else lack for i, g in enumerate(mine)), lang) for lang, p in profiles.items())
    return far[0][1], 1.0 if len(far) == 1 else (far[1][0] - far[0][0]) / far[1][0] if far[1][0] else 0.0


SCRIPTS = {
    "en": "The quick brown fox jumps over the lazy dog, and the dog sleeps.", "ru": "Съешь же ещё этих мягких французских булок, да выпей чаю.", "el": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία των ανθρώπων.",
    "zh": "我能吞下玻璃而不伤身体。今天天气很好，我们去公园。", "ja": "いろはにほへと ちりぬるを 私はガラスを食べられます。", "ko": "나는 유리를 먹을 수 있어요. 그래도 아프지 않아요.",
}


def test_language_against_brute_force(spark):
    from loomspan.llm.language import learn, predict

    rng = np.random.default_rng(4)
    known = [(i, t, k) for i, (k, t) in enumerate(SCRIPTS.items())] + [(10, SCRIPTS["en"], "en"), (11, None, "en"), (12, "unlabelled", None), (13, "", "ru")]
    profiles = learn(spark.createDataFrame(known, "doc_id long, text string, lang string"), 60)
    want = {}
    for k in SCRIPTS:
        total = sum((ngrams(t) for _, t, lang in known if lang == k), Counter())
        want[k] = by_count(total, 60)
    spelled = {k: ["".join("" if not x else " " if x == 1 else chr(x - 2) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF)) for c in p] for k, p in profiles.items()}
    assert spelled == want
    texts = [None, "", "12 !", "ⴰⴱⴳ ⴷⴹ", "\U00020000\U00020001", "x", "a" * 3000, "Ünïcödé İstanbul", *SCRIPTS.values(), *SCRIPTS.values()]
    texts += ["".join(rng.choice(list(SCRIPTS[k]), 50)) for k in SCRIPTS] + [SCRIPTS["ja"][:9] + SCRIPTS["zh"][:9], "我们 去", "the end " * 200_000]
    got = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles, 40).collect()
    for r in got:
        lang, score = guess(texts[r.doc_id], want, 40)
        assert (r.lang_pred, round(r.score, 12)) == (lang, round(score, 12)), texts[r.doc_id]
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)][8:14] == list(SCRIPTS)


def test_language(spark):
    from loomspan.llm.language import learn, op7_language_id, predict

    docs = spark.createDataFrame([(1, "the cat and the dog and the bird", "en"), (2, "le chat et le chien de la maison", "fr"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    profiles = learn(docs)
    asked = spark.createDataFrame([(1, "the bird and the cat", 5.0), (2, "le chien et la maison", 1.0), (3, None, 1.0), (4, "", 1.0), (5, "12 !", 1.0), (6, "中文", 1.0), (7, "le " * 400_000, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in predict(asked, profiles).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "fr", "und", "und", "und"] and got[6].lang_pred != "und" and got[7].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in predict(asked, learn(docs.where("false"))).collect()} == {"und"}
    sf = "/root/testdata/sf0.01"
    right = op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    n, ok = right.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert ok / n >= 0.95, (ok, n)
