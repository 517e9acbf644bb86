"""Operator 11: ranked lexical search with block-max pruning.

The index cuts the documents, as they are scanned, into ranges of about ``block_bytes`` of text. A block is a row: a forward index
(each document's terms and their frequencies) and, beside it, the block's terms with their document counts and *maxima*, the
largest factor that a term reaches in any document of the block. A query's bound on a block is the sum of its terms' weights
times their maxima; no document of the block scores more.

A search reads the small columns first. It counts the documents of the asked terms, and finds for each item the ``seeds`` blocks
of highest bound anywhere; scoring these gives a score that the item's k-th document reaches at least. Then each task takes
its blocks, some megabytes of them at a time, in the order of their bounds, and scores them until the bound drops below that
score or below the k-th score it has itself found. A bound equal to it is still scored, as ties go to the smaller doc_id.
What leaves a task are at most k documents an item, none below the score known from the seeds.

Items are read in parts of about ``part_words`` words, one search each, so what is broadcast is bounded and the number of items is not.

Terms are 64-bit hashes of words (``ALNUM``). Nulls: a null or wordless text is no document; a null doc_id sorts before the
others; an item without words has no result; a null item_id is an item of its own. Repeated rows are ranked each. A very long text is a block of its
own. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import ALNUM, chunk_words, chunks, slices, small_batches, staged, table, words

BLOCK = "block long, doc_ids binary, known binary, lengths binary, starts binary, numbers binary, tfs binary, terms binary, dfs binary, maxima binary"
#: Bytes of blocks that a task orders by their bounds at once.
HELD = 16 << 20


def _texts(batches, *more):
    for batch in slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in more), (t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()), strict=True)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms with repeats)."""

    def run(batches):
        n_docs = n_terms = 0
        for part in chunks(_texts(batches), 1 << 20):
            raw = np.frombuffer(b" ".join(t for (t,) in part).translate(ALNUM), np.uint8) != 32
            starts = np.flatnonzero(raw & ~np.concatenate(([False], raw[:-1]))) if len(raw) else np.zeros(0, np.int64)
            each = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for (t,) in part)])))
            n_docs, n_terms = n_docs + int((each > 0).sum()), n_terms + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n_docs], pa.int64()), "l": pa.array([n_terms], pa.int64())})

    small_batches(docs.sparkSession)
    row = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


def factors(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied with: tf occurrences in a document of n terms."""
    m = 50 + (50 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, block_bytes: int = 1 << 17) -> DataFrame:
    """Blocks over whole documents, see the module; the maxima hold for a corpus of this size."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for part in chunks(((d, t) for d, t in _texts(batches, "doc_id")), block_bytes):
            h, _, _, first, _ = chunk_words([t for _, t in part], ALNUM)
            n = np.diff(first)
            if not len(h):
                continue
            kept = np.flatnonzero(n)
            terms, number = np.unique(h, return_inverse=True)
            entry, tf = np.unique(np.repeat(np.arange(len(kept)), n[kept]) * len(terms) + number.ravel(), return_counts=True)
            doc, number = entry // len(terms), entry % len(terms)
            maxima = np.zeros(len(terms), np.int64)
            np.maximum.at(maxima, number, factors(tf, n[kept][doc], n_docs, n_terms))
            ids = [part[i][0] for i in kept.tolist()]
            columns = {
                "doc_ids": np.array([d or 0 for d in ids], np.int64), "known": np.array([d is not None for d in ids], np.uint8), "lengths": n[kept].astype(np.int64),
                "starts": np.searchsorted(doc, np.arange(len(kept) + 1)).astype(np.int64), "numbers": number.astype(np.uint32), "tfs": tf.astype(np.uint32),
                "terms": terms, "dfs": np.bincount(number, minlength=len(terms)).astype(np.uint32), "maxima": maxima.astype(np.uint32),
            }
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()})
            block += 1

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


class Asked:
    """Some items: the distinct terms of all, each item's terms as numbers of those, and the terms' weights once they are known."""

    def __init__(self, texts: list[str | None]):
        own = [np.unique(words((t or "").encode(), ALNUM)[0]) for t in texts]
        self.wanted, number = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.numbers, self.first = number.ravel(), np.cumsum([0, *map(len, own)])
        self.live = np.flatnonzero(np.diff(self.first))
        self.weights = np.zeros(len(self.wanted), np.int64)
        self.known: dict[int, int] = {}
        self.floor = np.ones(len(texts), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        for i, n in df.items():
            self.weights[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def in_block(self, terms: np.ndarray) -> np.ndarray:
        """Place of each wanted term among a block's terms, -1 if it isn't there."""
        at = np.minimum(np.searchsorted(terms, self.wanted), len(terms) - 1)
        return np.where(terms[at] == self.wanted, at, -1)

    def bounds(self, places: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """For each item of ``live``, the bound on a block."""
        value = np.where(places >= 0, self.weights * maxima[places].astype(np.int64), 0)
        return np.add.reduceat(value[self.numbers], self.first[self.live])


class Block:
    """The entries of a block that belong to wanted terms, ready to be scored."""

    def __init__(self, row: dict, asked: Asked, places: np.ndarray, n_docs: int, n_terms: int):
        number, starts = np.frombuffer(row["numbers"], np.uint32), np.frombuffer(row["starts"], np.int64)
        self.ids, self.known = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], np.uint8)
        wanted = np.full(len(row["terms"]) // 8, -1)
        wanted[places[places >= 0]] = np.flatnonzero(places >= 0)
        mine = np.flatnonzero(wanted[number] >= 0)
        self.doc = np.searchsorted(starts, mine, "right") - 1
        self.wanted = wanted[number[mine]]
        tf = np.frombuffer(row["tfs"], np.uint32)[mine].astype(np.int64)
        self.value = asked.weights[self.wanted] * factors(tf, np.frombuffer(row["lengths"], np.int64)[self.doc], n_docs, n_terms)

    def scores(self, asked: Asked, item: int) -> np.ndarray:
        of = np.zeros(len(asked.wanted), bool)
        of[asked.numbers[asked.first[item] : asked.first[item + 1]]] = True
        some = of[self.wanted]
        # sums of whole numbers below 2**53, so exact as doubles
        return np.bincount(self.doc[some], self.value[some], len(self.ids)).astype(np.int64)


class Best:
    """The k best documents of an item so far, and the score that a further one must reach."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, floor, np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, block: Block) -> None:
        good = np.flatnonzero(scores >= self.floor)
        if len(good):
            rows = np.concatenate((self.rows, np.stack((-scores[good], block.known[good], block.ids[good]), axis=1)))
            self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))][: self.k]
            if len(self.rows) == self.k:
                self.floor = max(self.floor, int(-self.rows[-1, 0]))


def _found(best: dict[int, Best]) -> pa.RecordBatch:
    rows = [(i, -s, d if known else None) for i, b in best.items() for s, known, d in b.rows.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "score", "doc_id"])


def _loads(batches):
    """The rows of blocks, in lists of about ``HELD`` bytes."""
    held, n = [], 0
    for batch in slices(batches, 1):
        held += batch.to_pylist()
        n += batch.nbytes
        if n >= HELD:
            yield held
            held, n = [], 0
    if held:
        yield held


def document_counts(index: DataFrame, asked) -> dict[int, int]:
    """Documents in which each wanted term occurs. asked: a broadcast Asked."""

    def run(batches):
        total = np.zeros(len(asked.value.wanted), np.int64)
        for batch in slices(batches, 64):
            for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
                places = asked.value.in_block(np.frombuffer(terms, np.uint64))
                total[places >= 0] += np.frombuffer(dfs, np.uint32)[places[places >= 0]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["term", "df"])

    return {r.term: r.df for r in index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best_blocks(index: DataFrame, asked, seeds: int) -> DataFrame:
    """(item, block) of the ``seeds`` blocks of highest bound for each item, from the small columns alone."""

    def run(batches):
        items = asked.value.live
        top, held, places = np.zeros((len(items), 0), np.int64), [], []
        for batch in slices(batches, 64):
            for block, terms, maxima in zip(*(batch.column(c).to_pylist() for c in ("block", "terms", "maxima")), strict=True):
                held.append(asked.value.bounds(asked.value.in_block(np.frombuffer(terms, np.uint64)), np.frombuffer(maxima, np.uint32)))
                places.append(block)
        if not places or not len(items):
            return
        top = np.stack(held, axis=1)
        first = np.argsort(-top, axis=1, kind="stable")[:, :seeds]
        rows = [(int(items[i]), int(top[i, j]), places[j]) for i in range(len(items)) for j in first[i].tolist() if top[i, j] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "bound", "block"])

    found = index.select("block", "terms", "maxima").mapInArrow(run, "item int, bound long, block long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return found.withColumn("nth", place).where(F.col("nth") <= seeds).select("item", "block")


def search_blocks(index: DataFrame, asked, k: int, n_docs: int, n_terms: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(item, score, doc_id): a task's k best of each item, by block-max pruning; ``only``: block -> the items to score it for."""

    def run(batches):
        a = asked.value
        best = {int(i): Best(k, int(a.floor[i])) for i in a.live}
        for rows in _loads(batches):
            places = [a.in_block(np.frombuffer(r["terms"], np.uint64)) for r in rows]
            made: dict[int, Block] = {}

            def block(j):
                if j not in made:
                    made[j] = Block(rows[j], a, places[j], n_docs, n_terms)  # noqa: B023
                return made[j]  # noqa: B023

            if only is not None:
                for j, r in enumerate(rows):
                    for i in only.get(r["block"], ()):
                        best[i].add(block(j).scores(a, i), block(j))
                continue
            bounds = np.stack([a.bounds(p, np.frombuffer(r["maxima"], np.uint32)) for p, r in zip(places, rows, strict=True)], axis=1) if len(a.live) else np.zeros((0, len(rows)), np.int64)
            for i, bound in zip(a.live.tolist(), bounds, strict=True):
                for j in np.argsort(-bound, kind="stable").tolist():
                    if bound[j] < best[i].floor:
                        break
                    best[i].add(block(j).scores(a, i), block(j))
        yield _found(best)

    return index.mapInArrow(run, "item int, score long, doc_id long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, ranked from 1."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, seeds: int = 4, part_words: int = 1 << 16) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    n_docs, n_terms = corpus_size(docs)
    index = staged(build_index(docs, n_docs, n_terms), "blocks", compression="zstd")
    # a word takes two bytes at least, so the sizes bound the words
    sized = items.select("item_id", "text")
    total = sized.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    parts, results = max(1, -(-int(total) // part_words)), []
    for p in range(parts):
        rows = list(sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toLocalIterator())
        asked = Asked([r.text for r in rows])
        if not len(asked.live):
            continue
        held = context.broadcast(asked)
        asked.weigh(document_counts(index, held), n_docs)
        held.destroy()
        held = context.broadcast(asked)
        only: dict[int, list[int]] = {}
        for r in best_blocks(index, held, seeds).collect():
            only.setdefault(r.block, []).append(r.item)
        # the blocks' files are told by the block's number, so most are not read
        few = index.where(F.col("block").isin(list(only)))
        for r in ranked(search_blocks(few, held, k, n_docs, n_terms, only), k).where(F.col("rank") == k).select("item", "score").collect():
            asked.floor[r.item] = r.score
        held.destroy()
        held = context.broadcast(asked)
        best = staged(ranked(search_blocks(index, held, k, n_docs, n_terms), k), "ranked")
        held.destroy()
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return sized.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(w) AS term FROM b)),
size AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
wanted AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS wt FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM it) GROUP BY term), size),
part AS (SELECT doc_id, term, wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))) AS s FROM tf JOIN wanted USING (term), size),
total AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM it JOIN part USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0) WHERE rank <= 50
"""
