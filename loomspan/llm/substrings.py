"""Operator 4: removal of passages that have occurred before, with suffix automata of reference shards.

A window is ``window`` consecutive words; it is removed if its word sequence also starts earlier (smaller doc_id, or same
document, earlier start). The reference is the corpus itself, so its automata cannot be broadcast; instead the corpus is
cut into shards such that equal windows meet in one shard, and each shard has an automaton of its own:

1. Every run of ``gram`` words is hashed; a window's *key* is the smallest hash in it. Consecutive windows of one key form
   a *piece* (its words, and where it starts). Equal windows have equal keys. Only (key, hash of the piece, place) is
   shuffled. Pieces equal to an earlier one of the same chunk need no meeting: they are removed at once, so a passage that
   a third of all documents share reaches its shard once a chunk.
2. Where all pieces of a key are equal, all but the first are removed. Where they differ, the words of those pieces are
   fetched and dealt by key. Each key's pieces are streamed in the order of (doc_id, start) through the suffix automaton of
   what came before: its matching statistics give, for each word, how long a match with the reference ends there; windows
   that end in a match of ``window`` words or more are removed, and a piece with anything new is added. Keys with more than
   ``most`` pieces are dealt by single windows (key and hash of the window) instead, so no automaton outgrows a task.
3. What is to go is gathered by document and cut from the texts.

Nulls: a null text has no words; a null doc_id comes before all others. Rows of one doc_id (or of none) with different texts
are documents of their own, in the order of a hash of the text; repeated rows are one document, and lose the same. Texts
shorter than a window, and empty tables, lose nothing. A very long text is cut in one task, whose memory holds it. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import PLAIN, chunk_words, chunks, mix, run_hashes, slices, small_batches, staged, table

LOW = -(2**63)
#: place = start << 5 | inner repeat << 4 | windows in the piece
_START, _SELF = 5, 4
MOST_WINDOWS = 15


class Automaton:
    """A suffix automaton of word sequences, grown online. Words are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            p = last
            if w in nxt[p]:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    last = q
                else:
                    last = self._clone(p, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        out = []
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            else:
                v = n = 0
            out.append(n)
        return out


def _pieces(texts: list[bytes], window: int, gram: int):
    """Of each piece: text number, first word in its text, windows, key, hash, inner repeat; and the words' byte places."""
    h, s, e, first, joined = chunk_words(texts, PLAIN)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    span = window - gram + 1
    if len(h) < window:
        return None, (s, e, first, joined)
    grams = run_hashes(h, np.arange(len(h) - gram + 1), np.full(len(h) - gram + 1, gram))
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    low = views[:, 0].copy()
    at = np.zeros(len(low), np.int32)
    for k in range(1, span):
        less = views[:, k] < low
        low[less] = views[less, k]
        at[less] = k
    start = np.flatnonzero(owner[: len(low)] == owner[window - 1 :])  # windows that lie in one text
    if not len(start):
        return None, (s, e, first, joined)
    low, at = low[start], at[start] + start
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)))
    head = np.flatnonzero(new)
    nth = np.arange(len(low)) - np.repeat(head, np.diff(np.append(head, len(low))))
    head = np.flatnonzero(nth % MOST_WINDOWS == 0)
    count = np.diff(np.append(head, len(low)))
    moved = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
    inner = moved[head + count - 1] > moved[head]
    begin = start[head]
    return (owner[begin], begin - first[owner[begin]], count, low[head], run_hashes(h, begin, count + window - 1), inner), (s, e, first, joined)


def _places(start, inner, count):
    return (start.astype(np.int64) << _START) | (inner.astype(np.int64) << _SELF) | count.astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 6, most: int = 2000) -> DataFrame:
    """One row a row: doc_id, n_words, n_removed, kept (words that stay, joined by blanks), kept_sha256."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    # the tag tells rows of one doc_id apart
    texts = docs.select(F.coalesce("doc_id", F.lit(LOW)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tag"))

    def rows_of(batches, *more):
        for batch in slices(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", *more)), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)

    def sample(batches):
        for part in chunks(rows_of(batches), 1 << 20):
            found, _ = _pieces([r[-1] for r in part], window, gram)
            if found is None:
                continue
            owner, start, count, key, whole, inner = found
            doc, tag = (np.array([r[i] for r in part], np.int64)[owner] for i in (0, 1))
            place = _places(start, inner, count)
            order = np.lexsort((start, tag, doc, whole, key))
            k, w, d, t, s = key[order], whole[order], doc[order], tag[order], start[order]
            again = np.concatenate(([False], (k[1:] == k[:-1]) & (w[1:] == w[:-1])))
            # an equal place (rows repeated) is not earlier
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))
            gone = again & ((d != d[lead]) | (t != t[lead]) | (s != s[lead]))
            k = np.where(gone, mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64)), k)
            yield pa.RecordBatch.from_pydict({"key": pa.array(k.astype(np.int64)), "whole": pa.array(w.astype(np.int64)), "doc": pa.array(d), "tag": pa.array(t), "place": pa.array(place[order]), "gone": pa.array(gone)})

    found = staged(texts.mapInArrow(sample, "key long, whole long, doc long, tag long, place long, gone boolean"), "found")
    # what is known of a key is summed up before it is dealt, then joined: a passage of every document is one row a task, and
    # the pieces of its key may be split among tasks. Most keys have one piece, of which nothing goes.
    here, pieces = F.struct("doc", "tag", F.shiftright("place", _START).alias("start")), found.where("not gone")
    known = pieces.groupBy("key").agg(F.count("*").alias("n"), F.min(here).alias("first"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.max(F.shiftright("place", _SELF).bitwiseAND(1)).alias("inner"))
    known = known.where("n > 1 or inner = 1").select("key", "n", "first", ((F.col("low") != F.col("high")) | (F.col("inner") == 1)).alias("open"))
    judged = pieces.join(known, "key").select("key", "doc", "tag", "place", "n", "open", (here > F.col("first")).alias("later")).where("open or later")
    again = found.where("gone").select("key", "doc", "tag", "place", F.lit(0).cast("long").alias("n"), F.lit(False).alias("open"), F.lit(True).alias("later"))
    judged = staged(judged.unionByName(again), "pieces")
    removed = judged.where("not open").select("doc", "tag", "place")

    # --- keys whose pieces differ: the automata
    asked = judged.where("open").groupBy("doc", "tag").agg(F.collect_set(F.struct("place", "key", "n")).alias("asked"))

    def fetch(batches):
        for part in chunks(rows_of(batches, "asked"), 1 << 20):
            out = []
            _, s, e, first, joined = (None, *_words([r[-1] for r in part]))
            for i, (doc, tag, wanted, _) in enumerate(part):
                for a in wanted:
                    place = a["place"]
                    lo, n = first[i] + (place >> _START), place & 15
                    turns = [(lo + k, 1) for k in range(n)] if a["n"] > most or (place >> _SELF) & 1 else [(lo, n)]
                    for at, m in turns:
                        text = b" ".join(joined[x:y] for x, y in zip(s[at : at + m + window - 1].tolist(), e[at : at + m + window - 1].tolist(), strict=True))
                        shard = a["key"] if a["n"] <= most else int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                        out.append((shard, a["key"], doc, tag, (int(at - first[i]) << _START) | m, text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (*[pa.int64()] * 5, pa.binary()), strict=True)], ["shard", "key", "doc", "tag", "place", "words"])

    def stream(batches):
        now, automaton, held, at = None, None, [], None
        for batch in batches:
            gone = []
            for shard, key, doc, tag, place, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "doc", "tag", "place", "words")), strict=True):
                if (shard, key) != now:
                    now, automaton, held, at = (shard, key), Automaton(), [], None
                here = (doc, tag, place >> _START)
                if here != at:
                    for w in held:
                        automaton.add(w)
                    held, at = [], here
                w = text.split(b" ")
                n = automaton.matches(w)[window - 1 :]
                for k, m in enumerate(n):
                    if m >= window:
                        gone.append((doc, tag, ((here[2] + k) << _START) | 1))
                if min(n) < window:
                    held.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*gone, strict=True) if gone else [[]] * 3)], ["doc", "tag", "place"])

    words_of = texts.join(asked, ["doc", "tag"]).mapInArrow(fetch, "shard long, key long, doc long, tag long, place long, words binary")
    dealt = words_of.repartition("shard", "key").sortWithinPartitions("shard", "key", "doc", "tag", "place")
    removed = staged(removed.unionByName(dealt.mapInArrow(stream, "doc long, tag long, place long")), "removed")

    # --- the texts without what is to go
    lists = removed.groupBy("doc", "tag").agg(F.collect_set("place").alias("places"))

    def cut(batches):
        for batch in slices(batches):
            out = []
            for doc, _, places, text in rows_of([batch], "places"):
                words_ = text.translate(PLAIN).split()
                gone = 0
                if places:
                    p = np.array(places, np.int64)
                    edge = np.zeros(len(words_) + 1, np.int64)
                    np.add.at(edge, p >> _START, 1)
                    np.add.at(edge, (p >> _START) + (p & 15) + window - 1, -1)
                    out_ = np.cumsum(edge)[:-1] > 0
                    gone = int(out_.sum())
                    if gone:
                        words_ = [w for w, g in zip(words_, out_.tolist(), strict=True) if not g]
                kept = b" ".join(words_)
                out.append((None if doc == LOW else doc, len(words_) + gone, gone, kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return texts.join(lists, ["doc", "tag"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def _words(texts: list[bytes]):
    _, s, e, first, joined = chunk_words(texts, PLAIN)
    return s, e, first, joined


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS gone_n, CASE WHEN ps IS NULL THEN array_to_string(w, ' ') END AS whole FROM d LEFT JOIN g USING (doc_id)),
part AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d JOIN g USING (doc_id)) u
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = u.doc_id AND gone.p = u.p) GROUP BY doc_id)
SELECT kept.doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone_n AS BIGINT) AS n_removed, sha256(coalesce(whole, t, '')) AS kept_sha256 FROM kept LEFT JOIN part USING (doc_id)
"""
