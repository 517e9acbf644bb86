"""BPE by a transducer against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

ALPHABET = "abcXYZ éÉüßñ0129'’.,;!?-<|>\n\t  ́̈İıſKǅʼnΣσςа中文ㄱ각가🙂‍﻿\x1c\x85ªº²½"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd_texts(n=3000, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "<|endoftext", "it's 'start we'll I'D don'tt", "ab" * 3000, "a" * 100 + " " + "é" * 70, "", " ", "\n"]


def lexicon_of(words, path, folder):
    from loomspan.llm import bpe

    flat, starts, counts = bpe.Merges(path).encode(words)
    entries = [(w, tuple(flat[a : a + n].tolist())) for w, a, n in zip(words, starts, counts, strict=True)]
    (folder / "lexicon").write_bytes(bpe.compile_lexicon(entries))
    return bpe.Lexicon(folder / "lexicon"), entries


def test_encoder_is_the_library(path, library, tmp_path):
    from loomspan.llm import bpe

    texts = odd_texts()
    words = sorted({w for t in texts[:500] for w in bpe.Splitter(path).split([t])[0] if w})
    for lexicon in (None, lexicon_of(words, path, tmp_path)[0]):
        ids, first = bpe.Encoder(path, lexicon).encode(texts)
        for k, t in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_transducer_is_exact_and_minimal(path, tmp_path):
    words = sorted({a + b + c for a in (b"un", b"re", b"") for b in (b"do", b"make", b"stat") for c in (b"", b"ing", b"ings", b"able", b"ation")})
    lexicon, entries = lexicon_of(words, path, tmp_path)
    known, ids, each = lexicon.walk(words)
    assert known.tolist() == list(range(len(words)))
    assert [tuple(x.tolist()) for x in np.split(ids, np.cumsum(each)[:-1])] == [o for _, o in entries]
    assert len(lexicon.walk([w + b"x" for w in words] + [b"", b"u", b"zzz", b"un" * 40])[0]) == 0
    # no two states have the same future
    futures = set()
    for s in range(len(lexicon.final)):
        own = np.flatnonzero(lexicon.keys >> 8 == s)
        out = lambda e: tuple(lexicon.ids[lexicon.first[e] : lexicon.first[e + 1]].tolist())
        futures.add((bool(lexicon.final[s]), out(len(lexicon.keys) + s), tuple((int(lexicon.keys[e] & 255), int(lexicon.target[e]), out(e)) for e in own)))
    assert len(futures) == len(lexicon.final) < sum(map(len, words))


def test_frequent_words_are_bounded_and_counted_over_all_rows(spark, path):
    from loomspan.llm import bpe

    docs = spark.createDataFrame([("b a a",), ("a c c",), (None,), ("d",)], "text string")
    assert {bytes(r.word): r.n for r in bpe.word_counts(docs, path).collect()} == {b"a": 3, b"b": 1, b"c": 2, b"d": 1}
    assert bpe.frequent_words(docs, path, 4) == [b"a", b"b", b"c", b"d"]
    assert bpe.frequent_words(docs, path, 3) == [b"a", b"c"]  # b and d tie: both stay out
    assert bpe.frequent_words(docs, path, 0) == []


def test_rows(spark, path, library):
    """Nulls, empty and long texts (cut at blanks), repeated rows, clashing columns, an empty table."""
    from loomspan.llm import bpe

    long = " ".join(f"word{i % 977}x" for i in range(400_000))
    rows = [(1, None), (2, ""), (None, "Hello  wörld"), (3, long), (3, "x"), (3, "x"), *((10 + i, t) for i, t in enumerate(odd_texts(200, 2)))]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, ids int, word string")
    got = bpe.decode(bpe.encode(docs, path, bpe.make_lexicon(docs, path, 50)), path).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, library.decode(ids, skip_special_tokens=False), ids))
    assert sorted(((r.doc_id, r.text, list(r.ids)) for r in got), key=key) == sorted(want, key=key)
    empty = docs.where("false")
    assert bpe.decode(bpe.encode(empty, path, bpe.make_lexicon(empty, path)), path).collect() == []


def test_query(spark, sf, library):
    from loomspan.llm.queries import QUERIES

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_bpe"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    assert got == want
