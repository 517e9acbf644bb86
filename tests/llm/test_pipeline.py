"""The pipeline against brute force on a small table of its own."""

import zlib

import numpy as np
from test_brute import WORD, counts, lowered, made, similarity



def test_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    items = [(1, " ".join(f"b{i}" for i in range(14)))]
    rows = [(d, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(made(11, 80))]
    rows += [(500, "start " + items[0][1].upper() + " end", "en", "s1", 60), (501, "12 34", None, "s1", 5), (7, rows[7][1], "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = [counts(r[1]) for r in lettered]
    root = list(range(len(lettered)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(lettered):
        k = find(i)
        best[k] = min(best.get(k, r), r, key=lambda x: -1 if x[0] is None else x[0])
    window = tuple(WORD.findall(lowered(items[0][1])))
    wins = {window[i : i + 10] for i in range(5)}
    clean = [r for r in best.values() if not wins & {tuple(WORD.findall(lowered(r[1]))[i : i + 10]) for i in range(200)}]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r[0]), len(ids(r[1])) // 4, zlib.crc32(ids(r[1]))) for r in clean)
    assert 500 not in {r.doc_id for r in got} and 501 not in {r.doc_id for r in got}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    # in each source the documents come in the order of doc_id
    source = {r[0]: r[3] for r in clean}
    for s in set(source.values()):
        mine = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start) if source[r.doc_id] == s]
        assert mine == sorted(mine)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage keeps the columns, clashing ones too, and bears empty tables, very long texts, nulls and repeats."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, slot long, class_id long, n_hit long, file string, nth long, _id long, tid binary"
    more = (0.5, "x", 7, 8, 9, "f", 3, 4, b"t")
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, long, "en", "s", 5, *more), (2, "the bird sings in the tree", "en", None, 6, *more), (2, "the bird sings in the tree", "en", None, 6, *more), (None, "le chat dort dans la maison", "fr", "s", 6, *more), (4, None, None, None, None, *[None] * 9), (5, "", "en", "s", 0, *more)]
    spark.createDataFrame([(1, "b1 b2 b3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            before, docs = docs, stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert docs.columns == before.columns
        got = [(r.doc_id, r.n_tokens) for r in docs.collect()]
        # one of the repeated rows goes, and those without a letter
        assert sorted(str(d) for d, _ in got) == (["1", "2", "None"] if given else [])
        assert all(t > 1 for _, t in got)
