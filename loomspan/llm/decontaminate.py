"""Operator 2: benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: each task turns its documents into *segments*, and a segment stores, for every term of its
documents, the ascending positions of that term (term dictionary, list offsets, postings). A search takes each window of the
test items from its rarest term in the segment: that list, moved back by the term's offset, gives the candidate starts, and
the lists of the other terms, rarest first, are intersected with them at their own offsets. What is left is an exact phrase
match. With ``slop`` proximity matches are found too: a window is near at a place if each of its terms lies at most that many
words off its own place from there, so that a passage with a word put in or left out still matches. Free positions between documents keep matches from running over their ends.

Nothing is shuffled but the matches: a segment holds whole documents. The items are broadcast in blocks of at most about
``block_words`` words, one search pass a block; a pass ends, and its broadcast is destroyed, before the next begins, so the
number of items is not bounded. Terms are 64-bit hashes.

Nulls: a null text has no words, matches nothing and is still returned; items with null id or without words are left
out. Repeated rows are each judged. A very long text is a segment of its own (up to 2**32 words). Empty tables give no rows,
or rows without hits; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import ALNUM, chunk_words, chunks, run_hashes, slices, small_batches, staged, table, words

SEGMENT = "segment long, gap int, doc_ids binary, known binary, doc_starts binary, terms binary, list_starts binary, postings binary"
MATCHES = "segment long, ordinal int, doc_id long, n_words long, spans array<int>, item_ids array<string>, near_ids array<string>"


class Block:
    """Windows of some items: terms (their words one after the other), start and length of each window, and its items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.terms = np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)])
        self.names = [name for name, _ in items]
        n = np.array([len(h) for _, h in items], np.int64)
        each = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        owner = np.repeat(np.arange(len(items)), each)
        start = np.repeat(np.cumsum(n) - n - (np.cumsum(each) - each), each) + np.arange(len(owner))
        length = np.minimum(n[owner], window)
        # equal windows are one, with all their items
        _, one, same = np.unique(run_hashes(self.terms, start, length), return_index=True, return_inverse=True)
        self.start, self.length = start[one], length[one]
        order = np.lexsort((owner, same))
        self.owners, self.first = owner[order], np.searchsorted(same[order], np.arange(len(one) + 1))
        self.wanted = np.unique(self.terms)

    def items_of(self, w: int) -> list[str]:
        return [self.names[o] for o in self.owners[self.first[w] : self.first[w + 1]]]


def item_blocks(items: DataFrame, window: int, block_words: int):
    """Yield the items as blocks. The driver reads them in parts (by a hash of item_id) of about ``block_words`` words each, so
    that it and a broadcast hold one part whatever the number of items."""
    # a word takes two bytes at least, so the sizes bound the words
    sizes = items.where("item_id is not null and text is not null").select("item_id", "text", (F.octet_length("text") / 2).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    for b in range(blocks):
        yield Block([(str(r.item_id), words(r.text.encode(), ALNUM)[0]) for r in sizes.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()], window)


def build_index(docs: DataFrame, gap: int = 1, segment_bytes: int = 1 << 20) -> DataFrame:
    """Segments of the positional index over whole documents, with ``gap`` free positions after each document."""

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        rows = ((d, t or b"") for batch in slices(batches) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))
        for part in chunks(rows, segment_bytes):
            h, _, _, first, _ = chunk_words([t for _, t in part], ALNUM)
            starts = first + gap * np.arange(len(first))
            place = np.arange(len(h)) + gap * np.repeat(np.arange(len(part)), np.diff(first))
            order = np.argsort(h, kind="stable")
            h = h[order]
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([n], pa.int64()), "gap": pa.array([gap], pa.int32())}
                | {
                    k: pa.array([v.tobytes()], pa.binary())
                    for k, v in {
                        "doc_ids": np.array([d or 0 for d, _ in part], np.int64),
                        "known": np.array([d is not None for d, _ in part], np.uint8),
                        "doc_starts": starts.astype(np.int64),
                        "terms": h[heads],
                        "list_starts": np.append(heads, len(h)).astype(np.int64),
                        "postings": place[order].astype(np.uint32),
                    }.items()
                }
            )
            n += 1

    return docs.select("doc_id", "text").mapInArrow(run, SEGMENT)


def _meet(keys: np.ndarray, term: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which (term number, position) are in the postings; keys: all of them as term << 32 | position, ascending."""
    ask = (term.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return keys[at] == ask


def _near(keys: np.ndarray, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
    lo = np.searchsorted(keys, (term.astype(np.uint64) << np.uint64(32)) | np.maximum(place - slop, 0).astype(np.uint64))
    hi = np.searchsorted(keys, (term.astype(np.uint64) << np.uint64(32)) | (place + slop).astype(np.uint64), "right")
    return hi > lo


def match_segment(terms, lists, postings, block: Block, slop: int = 0, at_once: int = 1 << 21):
    """(window number, start position) of all matches of the windows of ``block`` in one segment."""
    out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # only the lists of terms that the block asks for are read
    asked = np.flatnonzero(np.isin(terms, block.wanted, assume_unique=True))
    if not len(asked):
        return out_w[0], out_p[0]
    sizes = np.diff(lists)[asked]
    heads = np.concatenate(([0], np.cumsum(sizes)))
    postings = postings[np.repeat(lists[asked] - heads[:-1], sizes) + np.arange(heads[-1])]
    terms, lists = terms[asked], heads
    keys = (np.repeat(np.arange(len(terms)), sizes).astype(np.uint64) << np.uint64(32)) | postings.astype(np.uint64)
    for size in np.unique(block.length):
        which = np.flatnonzero(block.length == size)
        grid = block.terms[block.start[which][:, None] + np.arange(size)]
        number = np.minimum(np.searchsorted(terms, grid), len(terms) - 1)
        live = (terms[number] == grid).all(axis=1)
        which, number = which[live], number[live]
        if not len(which):
            continue
        ranked = np.argsort(sizes[number], axis=1, kind="stable")
        count = sizes[np.take_along_axis(number, ranked[:, :1], 1)[:, 0]]
        lo = 0
        while lo < len(which):  # as many windows at once as have at_once candidates, one at least
            hi = lo + max(1, int(np.searchsorted(np.cumsum(count[lo:]), at_once)))
            w = np.repeat(np.arange(lo, min(hi, len(which))), count[lo:hi])
            rare = number[w, ranked[w, 0]]
            nth = np.arange(len(w)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
            start = postings[lists[rare] + nth].astype(np.int64) - ranked[w, 0]
            # each place from which the rarest term is near
            w, start = np.tile(w, 2 * slop + 1), np.concatenate([start + off for off in range(-slop, slop + 1)])
            w, start = w[start >= -slop], start[start >= -slop]
            for k in range(1, size):
                offset = ranked[w, k]
                ok = _near(keys, number[w, offset], start + offset, slop) if slop else _meet(keys, number[w, offset], start + offset)
                w, start = w[ok], start[ok]
            out_w.append(which[w])
            out_p.append(start)
            lo = hi
    return np.concatenate(out_w), np.concatenate(out_p)


def search(index: DataFrame, block, slop: int = 0) -> DataFrame:
    """One row a document of the index: words hit (as start, end pairs of positions in the document), item ids and, with
    ``slop``, the ids of items of which a window is near; exact matches are near ones too. block: a broadcast Block."""

    def run(batches):
        asked = block.value
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                docs, known = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], np.uint8)
                base, gap = np.frombuffer(row["doc_starts"], np.int64), row["gap"]
                arrays = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["list_starts"], np.int64), np.frombuffer(row["postings"], np.uint32)
                spans: list[list[int]] = [[] for _ in docs]
                items: list[set] = [set() for _ in docs]
                near: list[set] = [set() for _ in docs]
                w, p = match_segment(*arrays, asked)
                order = np.argsort(p, kind="stable")
                for i, start in zip(w[order].tolist(), p[order].tolist(), strict=True):
                    d = int(np.searchsorted(base, start, "right")) - 1
                    a, b = start - int(base[d]), start - int(base[d]) + int(asked.length[i])
                    if spans[d] and a <= spans[d][-1]:
                        spans[d][-1] = max(b, spans[d][-1])
                    else:
                        spans[d] += [a, b]
                    items[d].update(asked.items_of(i))
                if slop:
                    w, p = match_segment(*arrays, asked, slop)
                    # a start may lie up to slop before its document
                    for i, start in zip(w.tolist(), p.tolist(), strict=True):
                        near[int(np.searchsorted(base, start + slop, "right")) - 1].update(asked.items_of(i))
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([row["segment"]] * len(docs), pa.int64()),
                        "ordinal": pa.array(range(len(docs)), pa.int32()),
                        "doc_id": pa.array([d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], pa.int64()),
                        "n_words": pa.array((np.diff(base) - gap).tolist(), pa.int64()),
                        "spans": pa.array(spans, pa.list_(pa.int32())),
                        "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        "near_ids": pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                    }
                )

    return index.mapInArrow(run, MATCHES)


def _merged(spans):
    """Union of (start, end) pairs sorted by start, as the number of positions covered."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc.n + F.greatest(s["b"] - F.greatest(s["a"], acc.end), F.lit(0))).alias("n"), F.greatest(acc.end, s["b"]).alias("end")),
    ).n.cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, block_words: int = 1 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, item_ids and near_ids (sorted strings)."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    index = staged(build_index(docs, 2 * slop + 1), "postings", compression="snappy")
    first, more = None, []
    for block in item_blocks(items, window, block_words):
        held = context.broadcast(block)
        if first is None:
            first = search(index, held, slop)
        else:
            more.append(staged(search(index, held, slop).where("size(spans) > 0 or size(near_ids) > 0"), "matches"))
            held.destroy()
    found = first
    for part in more:
        found = found.unionByName(part)
    if more:
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "item_ids", "near_ids")))
    pairs = F.expr("transform(sequence(0, int(size(spans) / 2) - 1), i -> struct(spans[2 * i] as a, spans[2 * i + 1] as b))")
    return found.select("doc_id", "n_words", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(_merged(pairs)).alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), F.array_sort(F.array_distinct("near_ids")).alias("near_ids"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the exact hits, n_near and near_sha256: items of which a window is near, with a word put in or left out."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=1)
    listed = lambda c: F.sha2(F.concat_ws(",", c), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed("item_ids").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"), listed("near_ids").alias("near_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.n, dw.i, win.item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key FROM dw) dw JOIN win ON dw.n = win.n AND dw.key = win.key),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ww AS (SELECT bw.item_id, bw.i AS win, bw.n, k, w[bw.i + k] AS term FROM bw, range(0, 10) r(k) WHERE k < bw.n),
dp AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
nr AS (SELECT doc_id, item_id FROM dp JOIN ww USING (term), range(-1, 2) o(off) GROUP BY doc_id, item_id, win, n, p - k + off HAVING count(DISTINCT k) = n),
nid AS (SELECT doc_id, count(*) AS n_near, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM nr) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(nid.ids, '')) AS near_sha256
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nid USING (doc_id)
"""
