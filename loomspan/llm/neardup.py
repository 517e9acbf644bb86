"""Operator 5: near duplicates by DartMinHash signatures and banding.

A text is a weighted set: its five-word shingles (words as in ``ALNUM``; a shorter text is one shingle), each weighing as
often as it occurs. Darts are thrown at the plane of weight and rank: over each shingle the weight axis is cut into the
regions [0,1), [1,2), [2,4), [4,8), ..., and a hash of shingle and region throws darts into the region by a Poisson
process in rank. A dart counts if it lies below the shingle's weight. It belongs to one of the signature's coordinates,
and each coordinate keeps its earliest dart. Two texts agree in a coordinate with the probability of their weighted
Jaccard similarity. Only darts up to a rank that fills all coordinates are thrown, doubled for texts where it was too low.

Texts with equal word sequences are one *text* from then on (128-bit hash). The signature's bands file the texts in
buckets. In a bucket every text is compared with the bucket's centre, the text that shares its buckets with most others,
and with the one before it; buckets of up to ``small`` texts compare all pairs. In a group of near copies the text they
were made from is what they meet, so most links are found by candidates that grow with the texts and not with the square
of a bucket. Signatures settle candidates far from the threshold; those near it are settled on the exact shingle weights.
Links are joined to classes by star contraction. What is left are pairs of texts of different classes in the larger buckets.
Their texts are filed again, by exact prefixes: with the shingles of each in one order, rarest first (a shingle that occurs
k times counts as k), two texts as alike as the threshold asks share one among the first fifth of the larger text's and the
first ninth of the smaller one's. Pages that share a template but not their own part share no such shingle and never meet. Groups of
one class, without a text that has the shingle among its first ninth, or with the same texts as another group are dropped. In the others
each text is compared with those of another class, by signature, in blocks of 4096, and only texts leave the task that may be near
one of another class. These few are compared in the larger buckets in the same way, so that a pair counts once, and meet
there again, with their exact weights, in blocks of 2 MB; the pairs are
decided there and only links that join two classes leave the task, fewer than the block has classes. So no pair that shares
a band is left out, and no output grows with the square of a bucket.

Result: one row for each row of the input: doc_id, class_id (smallest doc_id of the class), n_class (rows in it),
is_kept (one row of each class). Null, empty and wordless texts are classes of their own each; a null doc_id counts as
the smallest; repeated rows fall in one class. A very long text is signed whole, in a task's memory. An empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import ALNUM, chunk_words, chunks, fresh, mix, run_hashes, runs_of, slices, small_batches, staged, table

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
SHINGLE = 5


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle hash, weight) of the distinct shingles of each text, and each text's 128-bit word hash [n, 2]."""
    h, _, _, first, _ = chunk_words(texts, ALNUM)
    n = np.diff(first)
    each = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    owner = np.repeat(np.arange(len(texts)), each)
    start = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    s = run_hashes(h, start, np.minimum(n[owner], size))
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])))) if len(s) else np.zeros(0, np.int64)
    weight = np.diff(np.append(head, len(s)))
    whole = np.stack([run_hashes(h, first[:-1], n), run_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first[:-1], n)], axis=1)
    return owner[head], s[head], weight, whole


def _unit(x: np.ndarray) -> np.ndarray:
    """A hash as a number in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def _throw(owner, s, weight, limit, n_texts: int, k: int):
    """Darts of rank up to limit[owner]: signature [n, k] of earliest darts; 0 where none fell."""
    rank = np.full(n_texts * k, np.inf)
    dart = np.zeros(n_texts * k, np.uint64)
    cells, ranks, names = [], [], []
    region, low, high = 0, 0.0, 1.0
    own, key, w = owner, s, weight.astype(np.float64)
    while len(own):
        seed, at, mine, heavy, turn = mix(key + np.uint64((0x632BE59BD9B4E019 * (region + 1)) & (2**64 - 1))), np.zeros(len(own)), own, w, 0
        while len(seed):
            seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log(_unit(seed)) / (high - low)
            live = at <= limit[mine]
            seed, at, mine, heavy = seed[live], at[live], mine[live], heavy[live]
            lands = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
            under = low + _unit(lands) * (high - low) <= heavy
            name = mix(lands + np.uint64(0x8CB92BA72F3D8DD7))[under]
            cells.append(mine[under] * k + (name % np.uint64(k)).astype(np.int64))
            ranks.append(at[under])
            names.append(name)
            turn += 1
        region, low, high = region + 1, high, high * 2
        more = w > low
        own, key, w = own[more], key[more], w[more]
    if cells:
        cell, r, name = np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(rank, cell, r)
        first = r == rank[cell]
        dart[cell[first]] = name[first] | np.uint64(1)
    return dart.reshape(n_texts, k)


def signatures(owner, s, weight, n_texts: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash signatures [n_texts, k]; a text without shingles has zeros."""
    total = np.bincount(owner, weights=weight, minlength=n_texts)
    darts = k * (np.log(k) + 2)
    out = np.zeros((n_texts, k), np.uint64)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        place = np.full(n_texts, -1)
        place[todo] = np.arange(len(todo))
        mine = place[owner] >= 0
        got = _throw(place[owner[mine]], s[mine], weight[mine], darts / total[todo], len(todo), k)
        full = (got != 0).all(axis=1)
        out[todo[full]] = got[full]
        todo, darts = todo[~full], 2 * darts
    return out


def _bytes16(pair: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(pair).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, tid binary (null: no words), bands array<long>, brief binary): brief has a byte a coordinate."""

    def run(batches):
        rows = ((d, x, t or b"") for batch in slices(batches) for d, x, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))
        for part in chunks(rows, 1 << 19):
            owner, s, weight, whole = shingles([r[-1] for r in part])
            # equal texts of the chunk are signed once
            _, one, back = np.unique(whole, axis=0, return_index=True, return_inverse=True)
            back = back.ravel()
            place = np.full(len(part), -1)
            place[one] = np.arange(len(one))
            mine = place[owner] >= 0
            sig = signatures(place[owner[mine]], s[mine], weight[mine], len(one))
            band = np.stack([run_hashes(sig[:, b * ROWS : (b + 1) * ROWS].ravel() + np.uint64(b), np.arange(len(one)) * ROWS, np.full(len(one), ROWS)) for b in range(BANDS)], axis=1).astype(np.int64)[back]
            brief = [x.tobytes() for x in (sig >> np.uint64(8)).astype(np.uint8)]
            worded = np.bincount(owner, minlength=len(part)) > 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in part], pa.int64()),
                    "text_hash": pa.array([r[1] for r in part], pa.int64()),
                    "tid": pa.array([t if w else None for t, w in zip(_bytes16(whole), worded.tolist(), strict=True)], pa.binary()),
                    "bands": pa.array(list(band), pa.list_(pa.int64())),
                    "brief": pa.array([brief[i] for i in back.tolist()], pa.binary()),
                }
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, tid binary, bands array<long>, brief binary")


def candidates(texts: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of ``texts`` (tid, bands) that are compared first; texts of larger buckets (bucket, tid)."""
    filed = texts.select("tid", F.explode("bands").alias("bucket"))
    counted = filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(filed.join(counted, "bucket"), "buckets")
    weight = shared.groupBy("tid").agg(F.sum("n").alias("w"))
    held = staged(shared.join(weight, "tid"), "weighted-buckets")
    centre = held.groupBy("bucket").agg(F.max(F.struct("w", "tid")).tid.alias("other"))
    star = held.join(centre, "bucket").select("tid", "other")
    # the one before it within a part of the bucket; a large bucket has many parts
    part = F.pmod(F.xxhash64("tid"), F.greatest(F.lit(1), F.ceil(F.col("n") / 512)))
    chain = held.where(F.col("n") > small).withColumn("part", part).withColumn("other", F.lag("tid").over(Window.partitionBy("bucket", "part").orderBy(F.desc("w"), "tid"))).where("other is not null").select("tid", "other")
    few = held.where(F.col("n").between(3, small)).groupBy("bucket").agg(F.sort_array(F.collect_list("tid")).alias("tids"))
    inner = few.select(F.explode(F.flatten(F.transform("tids", lambda x, i: F.transform(F.slice("tids", F.lit(1), i), lambda y: F.struct(x.alias("tid"), y.alias("other")))))).alias("p")).select("p.*")
    pairs = star.unionByName(chain).unionByName(inner).where(F.col("tid") != F.col("other"))
    return pairs.select(F.least("tid", "other").alias("a"), F.greatest("tid", "other").alias("b")).distinct(), held.where(F.col("n") > small).select("bucket", "tid")


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (bucket, tid, ...) so that any two of a bucket meet in one run of equal (bucket, i, j).

    A bucket is cut into blocks, as many as ``blocks`` (bucket, blocks) says; run (i, j) holds blocks i and j (``part`` says
    which). Buckets that ``blocks`` lacks are left out.
    """
    cut = rows.join(blocks, "bucket").withColumn("part", F.pmod(F.xxhash64("tid"), "blocks"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.withColumns({"i": F.least("part", "_other"), "j": F.greatest("part", "_other")}).drop("_other", "blocks")


def _dealt(cut: DataFrame) -> DataFrame:
    return cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "part")


def _bytes(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def rare_groups(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, tid, lead): the texts of ``mixed`` (tid, root) by the rare shingles that two as alike as ``threshold`` must share.

    sets: (tid, s, w). lead: the shingle is among those that the smaller of two alike texts shares. Of a pair, one has to be lead.
    """

    def spelled(batches):
        for batch in slices(batches, 64):
            for tid, s, w in zip(*(batch.column(c).to_pylist() for c in ("tid", "s", "w")), strict=True):
                s, w = np.frombuffer(s, np.uint64), np.frombuffer(w, np.int32)
                nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                token = mix(np.repeat(s, w) + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).astype(np.int64)
                for at in range(0, len(token), 1 << 16):
                    part = token[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([tid] * len(part), pa.binary()), pa.array(part), pa.array(np.full(len(part), len(token)))], ["tid", "token", "size"])

    tokens = sets.join(mixed, "tid", "left_semi").mapInArrow(spelled, "tid binary, token long, size long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # shingles of one text alone come first; only their number matters
    ordered = tokens.join(shared, "token").groupBy("tid").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    own = F.col("size") - F.size("shared")
    first = lambda part: F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * part - 1e-9) + 1 - own).cast("int")
    some = ordered.withColumns({"probe": first(threshold), "lead": first(2 * threshold / (1 + threshold))}).where("probe > 0").join(mixed, "tid")
    filed = some.select("tid", "root", "lead", F.posexplode(F.transform(F.slice("shared", F.lit(1), F.col("probe")), lambda x: x.token)).alias("nth", "bucket"))
    filed = staged(filed.select("bucket", "tid", "root", (F.col("nth") < F.col("lead")).alias("lead")), "rare-shingles")
    groups = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("lead").alias("any"), F.sum(F.xxhash64("tid", "lead").cast("decimal(38,0)")).alias("who"))
    one = groups.where("any and low <> high").groupBy("n", "who").agg(F.min("bucket").alias("bucket"))
    return filed.join(one.select("bucket"), "bucket").select("bucket", "tid", "lead")


def meeting(large: DataFrame, roots: DataFrame, signed: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(bucket, tid, root) of the texts in ``large`` (bucket, tid) that a text of the bucket, but of another class, may be near to.

    roots: (tid, root), for a class's smallest tid no row; signed: (tid, brief, bands). Near: the estimate is ``least`` or more.
    A pair counts in the first bucket it shares, if ``signed`` has bands; where ``large`` has a flag ``lead``, one of a pair must have it.
    What leaves a task are texts and not pairs.
    """
    banded, led = "bands" in signed.columns, "lead" in large.columns

    def run(batches):
        for group in runs_of(batches, "bucket", "i", "j"):
            bucket, part = group.column("bucket")[0].as_py(), group.column("part").to_numpy()
            own = group.column("i")[0] == group.column("j")[0]
            edge = 0 if own else int(np.searchsorted(part, part[-1]))
            _, root = np.unique(_bytes(group.column("root"), np.uint64, 2), axis=0, return_inverse=True)
            root, brief = root.ravel(), _bytes(group.column("brief"), np.uint8, COORDINATES)
            band = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if banded else None
            lead = group.column("lead").to_numpy() if led else np.ones(len(part), bool)
            seen = np.zeros(len(part), bool)
            for k in range(len(part) if own else edge):
                other = np.flatnonzero((root[max(edge, k + 1) :] != root[k]) & (lead[max(edge, k + 1) :] | lead[k])) + max(edge, k + 1)
                other = other[(brief[other] == brief[k]).mean(axis=1) >= least]
                if len(other):
                    if banded:
                        shared = (band[other] == band[k]).argmax(axis=1)
                        other = other[band[k, shared] == bucket]
                    seen[other] = True
                    seen[k] |= len(other) > 0
            if seen.any():
                yield pa.RecordBatch.from_pydict({c: group.column(c).combine_chunks().filter(pa.array(seen)) for c in ("bucket", "tid", "root")})

    classed = large.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    several = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / block).alias("blocks")).where("low <> high")
    return _dealt(_in_blocks(classed, several.select("bucket", "blocks")).join(signed, "tid")).mapInArrow(run, "bucket long, tid binary, root binary").distinct()


def joining(near: DataFrame, brief: DataFrame, sets: DataFrame, threshold: float, sure: float, block: int = 2 << 20) -> DataFrame:
    """Links (a, b) between the classes of ``near`` (bucket, tid, root): a spanning forest for each two blocks of a bucket.

    Pairs whose estimate is near the threshold are decided here, on the exact weights, so that none of them leaves the task.
    """

    def run(batches):
        for group in runs_of(batches, "bucket", "i", "j"):
            part, own = group.column("part").to_numpy(), group.column("i")[0] == group.column("j")[0]
            edge = 0 if own else int(np.searchsorted(part, part[-1]))
            names, root = np.unique(_bytes(group.column("root"), np.uint64, 2), axis=0, return_inverse=True)
            root, brief = root.ravel(), _bytes(group.column("brief"), np.uint8, COORDINATES)
            sizes = np.array([len(x) // 8 for x in group.column("s").to_pylist()])
            known, ids = np.unique(np.frombuffer(b"".join(group.column("s").to_pylist()), np.uint64), return_inverse=True)
            weight = np.frombuffer(b"".join(group.column("w").to_pylist()), np.int32)
            first = np.concatenate(([0], np.cumsum(sizes)))
            total, mark = np.add.reduceat(weight, first[:-1]), np.zeros(len(known), np.int32)
            links: list[tuple[int, int]] = []
            now = root.copy()

            def link(k, others):
                for o in others.tolist():
                    if now[o] != now[k]:
                        links.append((root[k], root[o]))
                        now[now == now[o]] = now[k]

            for k in range(len(part) if own else edge):
                other = np.flatnonzero(now[max(edge, k + 1) :] != now[k]) + max(edge, k + 1)
                estimate = (brief[other] == brief[k]).mean(axis=1)
                link(k, other[estimate > threshold + sure])
                other = other[np.abs(estimate - threshold) <= sure]
                mine = slice(first[k], first[k + 1])
                mark[ids[mine]] = weight[mine]
                while len(other):
                    other = other[now[other] != now[k]]
                    n = max(1, int(np.searchsorted(np.cumsum(sizes[other]), 1 << 18)))
                    some, other = other[:n], other[n:]
                    if len(some):
                        start = np.cumsum(sizes[some]) - sizes[some]
                        at = np.arange(sizes[some].sum()) + np.repeat(first[some] - start, sizes[some])
                        both = np.add.reduceat(np.minimum(mark[ids[at]], weight[at]), start)
                        link(k, some[both / (total[k] + total[some] - both) >= threshold])
                mark[ids[mine]] = 0
            if links:
                raw = _bytes16(names)
                yield pa.RecordBatch.from_arrays([pa.array([raw[a] for a, _ in links], pa.binary()), pa.array([raw[b] for _, b in links], pa.binary())], ["a", "b"])

    load = sets.select("tid", (F.octet_length("s") * 1.5 + COORDINATES).cast("long").alias("load"))
    blocks = near.join(load, "tid").groupBy("bucket").agg(F.ceil(F.sum("load") / block).alias("blocks"))
    return _dealt(_in_blocks(near, blocks).join(brief, "tid").join(sets, "tid")).mapInArrow(run, "a binary, b binary").distinct()


def _agreeing(batches):
    for batch in batches:
        n = batch.num_rows
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, COORDINATES) if n else np.zeros((0, COORDINATES), np.uint8) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1), pa.float64())], ["a", "b", "estimate"])


def _jaccard(batches):
    for batch in slices(batches):
        out = []
        for p, u, q, v in zip(*(batch.column(c).to_pylist() for c in ("xs", "xw", "ys", "yw")), strict=True):
            p, u, q, v = (np.frombuffer(z, t) for z, t in ((p, np.uint64), (u, np.int32), (q, np.uint64), (v, np.int32)))
            _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
            both = int(np.minimum(u[i], v[j]).sum())
            out.append(both / (int(u.sum()) + int(v.sum()) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def shingle_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(tid, s binary, w binary): shingles and weights of the texts of ``asked`` (doc_id), which names a document of each."""

    def run(batches):
        rows = ((t or b"",) for batch in slices(batches) for t in batch.column("text").cast(pa.binary()).to_pylist())
        for part in chunks(rows, 1 << 19):
            owner, s, weight, whole = shingles([t for (t,) in part])
            at = np.searchsorted(owner, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_pydict(
                {"tid": pa.array(_bytes16(whole), pa.binary())}
                | {k: pa.array([v[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()) for k, v in (("s", s), ("w", weight.astype(np.int32)))}
            )

    small = -(2**63)
    known = docs.select(F.coalesce("doc_id", F.lit(small)).alias("doc_id"), "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    return staged(known.select("text").mapInArrow(run, "tid binary, s binary, w binary").dropDuplicates(["tid"]), "shingle-sets")


def _exact(docs: DataFrame, doubtful: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs of ``doubtful`` (a, b) with their exact similarity, from the texts of ``first`` (tid, doc_id)."""
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("tid")).distinct().join(first, "tid")
    sets = shingle_sets(docs, asked)
    x = sets.select(F.col("tid").alias("a"), F.col("s").alias("xs"), F.col("w").alias("xw"))
    y = sets.select(F.col("tid").alias("b"), F.col("s").alias("ys"), F.col("w").alias("yw"))
    return doubtful.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_jaccard, "a binary, b binary, similarity double")


def classes(links: DataFrame) -> DataFrame:
    """(tid, root) for the ends of ``links`` (a, b): root is the smallest tid that a is linked with, by star contraction."""
    edges, state = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), None
    if edges.isEmpty():
        return edges.toDF("tid", "root")
    while True:
        # large star: each node's larger neighbours are tied to its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours are tied to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        edges = staged(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("tid"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, threshold: float = 0.8, sure: float = 0.12, small: int = 8) -> DataFrame:
    """See the module. ``sure``: estimates farther than this from the threshold (four standard errors) are final."""
    small_batches(docs.sparkSession)
    rows = staged(sketch(docs).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    null_id = F.lit(-(2**63))
    texts = rows.where("tid is not null").groupBy("tid").agg(F.first("bands").alias("bands"), F.first("brief").alias("brief"), F.min(F.coalesce("doc_id", null_id)).alias("doc_id"))
    texts = staged(texts, "texts")
    pairs, large = candidates(texts.select("tid", "bands"), small)
    brief = texts.select("tid", "brief")
    judged = pairs.join(brief.select(F.col("tid").alias("a"), F.col("brief").alias("x")), "a").join(brief.select(F.col("tid").alias("b"), F.col("brief").alias("y")), "b")
    judged = staged(judged.select("a", "b", "x", "y").mapInArrow(_agreeing, "a binary, b binary, estimate double"), "estimates")

    doubtful = judged.where(F.abs(F.col("estimate") - threshold) <= sure)
    exact = _exact(docs, doubtful, texts.select("tid", "doc_id")).where(F.col("similarity") >= threshold)
    roots = classes(staged(judged.where(F.col("estimate") > threshold + sure).select("a", "b").unionByName(exact.select("a", "b")), "links"))

    # --- what larger buckets hold beyond these pairs
    classed = large.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    several = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = staged(classed.join(several, "bucket", "left_semi").select("tid", "root").distinct(), "mixed")
    one = rows.select("doc_id", "text_hash", "tid", "_row").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    near = None
    if not mixed.isEmpty():
        sets = shingle_sets(docs, mixed.join(texts.select("tid", "doc_id"), "tid"))
        met = meeting(rare_groups(mixed, sets, threshold), roots, brief, threshold - sure).select("tid").distinct()
        few = staged(texts.select("tid", "brief", "bands").join(met, "tid", "left_semi"), "few")
        near = staged(meeting(large.join(few.select("tid"), "tid", "left_semi"), roots, few, threshold - sure), "meeting")
    if near is not None and not near.isEmpty():
        merged = classes(staged(joining(near, brief, sets, threshold, sure), "joining"))
        one = one.join(merged.toDF("root", "top"), "root", "left").withColumn("root", F.coalesce("top", "root"))
    one = staged(one.select("doc_id", "text_hash", "_row", "root"), "classed")
    own = one.where("root is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"), F.lit(True).alias("is_kept"))
    # of several rows with the class's smallest doc_id one is kept
    sizes = one.where("root is not null").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", null_id).alias("doc_id"), "_row")).alias("lead"), F.count("*").alias("n_class"), F.min("doc_id").alias("class_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    joined = one.where("root is not null").join(sizes, "root")
    return joined.select("doc_id", "text_hash", F.when(F.col("nulls") == 0, F.col("class_id")).alias("class_id"), "n_class", (F.col("_row") == F.col("lead._row")).alias("is_kept")).unionByName(own)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; the rows are found again by doc_id and the text's hash."""
    kept = near_duplicates(docs).where("is_kept").select("doc_id", "text_hash").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}).distinct()
    own = fresh(docs, "_own")
    same = F.col("d.doc_id").eqNullSafe(F.col("k._id")) & (F.col(f"d.{own}") == F.col("k._hash"))
    found = docs.withColumn(own, F.xxhash64("text")).alias("d").join(kept.alias("k"), same, "left_semi")
    return found.dropDuplicates(["doc_id", own]).select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
