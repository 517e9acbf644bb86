"""Operator 7: language identification by rank-order profiles of character n-grams.

Text is split at whatever is no letter, and letters are made lower case; words stand between blanks. A language's profile is
the list of its ``profile`` most frequent 1- to 3-grams of code points, in order of frequency. A document's ``top`` most
frequent n-grams, all of them counted, are ranked alike; its out-of-place distance to a language is the sum of the differences
between the two ranks, and an n-gram that the language's profile lacks costs the profile's length. The smallest distance wins,
ties go to the language that sorts first. Ties of frequency go to the n-gram that sorts first by code points.

An n-gram is one exact number (21 bits a code point), so no two are taken for each other, in whatever script. Learning is one
distributed count of all labelled training texts; a task hands over its counts whenever it holds a million, and what reaches
the driver are the profiles alone (a few kB a language), which are broadcast.

Nulls and texts without a letter are ``und`` with score 0. A text none of whose n-grams is in any profile (say, of a script that
was not learned) is as far from every language: it gets the one that sorts first, with score 0. Texts are read whole, long ones
piece by piece. An empty training set gives ``und`` for all; an empty table no rows; repeated rows are each judged, and count
each in learning; columns named lang_pred or score are replaced. Score: (second distance - best) / second distance, from 0 to 1;
1 if only one language was learned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import chunks, slices, small_batches, table

#: Bits of a symbol in an n-gram's number: 0 is none, 1 outside a word, else the code point plus 2.
BITS = 21
PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """The symbol of each code point: 1 for what is no letter, else that of its lower case (of the first letter, if it has more)."""
    out = np.ones(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0]) + 2
    return out


def cut(text: str, size: int = PIECE) -> list[str]:
    """A text in pieces of about ``size``, cut at blanks, so that no n-gram is lost; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _merged(owner: np.ndarray, code: np.ndarray, n: np.ndarray):
    """Equal (owner, code) added up; sorted by both."""
    order = np.lexsort((code, owner))
    owner, code, n = owner[order], code[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(code) else np.zeros(0, np.int64)
    return owner[head], code[head], np.add.reduceat(n, head) if len(head) else n


def counted(texts: list[str]):
    """(text number, n-gram, times) of the n-grams of each text, sorted by text and n-gram."""
    pieces = [(i, p) for i, t in enumerate(texts) for p in cut(t)]
    found = []
    for part in chunks(pieces, PIECE):
        points = np.frombuffer((" " + "  ".join(p for _, p in part) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = _letters()[points]
        # few symbols occur in a chunk; numbered in their order they make short keys that sort as the n-grams do
        held = np.flatnonzero(np.bincount(symbol))
        base, s = len(held) + 1, (np.searchsorted(held, symbol) + 1).astype(np.int64)
        blank = int(np.searchsorted(held, 1)) + 1
        owner = np.repeat(np.arange(len(part)), [len(p) + 2 for _, p in part])
        word = s != blank
        a, b, c = s[:-2], s[1:-1], s[2:]
        one, two = np.flatnonzero(word), np.flatnonzero(word[:-1] | word[1:])
        three = np.flatnonzero(word[1:-1])
        key = np.concatenate((owner[one] * base**3 + s[one], owner[two] * base**3 + s[two] * base + s[two + 1], owner[three] * base**3 + (a[three] * base + b[three]) * base + c[three]))
        key.sort()
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times, key = np.diff(np.append(head, len(key))), key[head]
        full = np.concatenate(([0], held)).astype(np.int64)
        code = (full[key // base**2 % base] << (2 * BITS)) | (full[key // base % base] << BITS) | full[key % base]
        found.append((np.array([i for i, _ in part], np.int64)[key // base**3], code, times))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return out if len(pieces) == len(texts) else _merged(*out)


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of doc_id, as text, leaves 2 when divided by 4 (null doc_id: learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, profile: int = 400) -> dict[str, list[int]]:
    """Profiles: language -> its ``profile`` most frequent n-grams, most frequent first, from ``docs`` (text, lang)."""

    def run(batches):
        names: dict[str, int] = {}
        held, size = [], 0

        def handed():
            lang, code, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pydict({"lang": pa.array(list(names), pa.string()).take(pa.array(lang)), "code": pa.array(code), "n": pa.array(n)})

        for batch in slices(batches):
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
            at = 0
            for part in chunks(((t,) for t in batch.column("text").to_pylist()), 1 << 19):
                owner, code, n = counted([t for (t,) in part])
                held.append(_merged(lang[at + owner], code, n))
                at += len(part)
                size += len(held[-1][1])
                if size > 1 << 20:
                    yield handed()
                    held, size = [], 0
        if held:
            yield handed()

    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in known.withColumn("place", place).where(F.col("place") <= profile).orderBy("lang", "place").select("lang", "code").collect():
        out.setdefault(r.lang, []).append(r.code)
    return out


class Ranker:
    """Out-of-place distances to the profiles."""

    def __init__(self, profiles: dict[str, list[int]], top: int = 300):
        self.langs, self.top = list(profiles), top
        self.vocabulary = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.lack = max([len(p) for p in profiles.values()], default=0)
        # one column more: n-grams of no profile
        self.rank = np.full((len(self.langs), len(self.vocabulary) + 1), -1, np.int64)
        for i, p in enumerate(profiles.values()):
            self.rank[i, np.searchsorted(self.vocabulary, np.array(p, np.int64))] = np.arange(len(p))

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        owner, code, n = counted(texts)
        if not len(code) or not len(self.langs):
            return [("und", 0.0)] * len(texts)
        order = np.lexsort((-n, owner))  # stable: equal counts stay in the order of the n-grams
        owner, code = owner[order], code[order]
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        place = np.arange(len(owner)) - first[owner]
        owner, code, place = owner[place < self.top], code[place < self.top], place[place < self.top]
        at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
        rank = self.rank[:, np.where(self.vocabulary[at] == code, at, len(self.vocabulary))]
        out_of_place = np.where(rank >= 0, np.abs(rank - place), self.lack)
        live = np.flatnonzero(np.diff(first) > 0)
        distance = np.add.reduceat(out_of_place, np.searchsorted(owner, live), axis=1)
        best = np.argsort(distance, axis=0, kind="stable")
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for j, i in enumerate(live.tolist()):
            near, second = int(distance[best[0, j], j]), int(distance[best[1, j], j]) if len(best) > 1 else None
            out[i] = self.langs[best[0, j]], 1.0 if second is None else (second - near) / second if second else 0.0
        return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = 300) -> DataFrame:
    """``docs`` with lang_pred and score; every column of ``docs`` but text passes through unread."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    names = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        ranker = Ranker(held.value, top)
        for batch in slices(batches):
            found = []
            for part in chunks(((t or "",) for t in batch.column("text").to_pylist()), 1 << 18):
                found += ranker.judge([t for (t,) in part])
            columns = [batch.column(f.name) for f in names] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in names] + ["lang_pred", "score"])

    schema = type(docs.schema)([*names]).add("lang_pred", "string").add("score", "double")
    return docs.select(*(f.name for f in names)).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).drop("text")
