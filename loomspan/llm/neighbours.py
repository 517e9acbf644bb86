"""Operator 6: approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on at most ``sample_rows`` vectors (those of smallest hash of the row); every vector is then filed in a
leaf. A query visits leaves best bin first: a priority queue holds the branches met so far by their centre's inner
product with the query, and the best is opened next. How many leaves to visit is calibrated: for ``probes`` queries the
true neighbours are found by one pass over all rows, and visits are widened until ``recall`` of them lie in visited leaves.
A query whose leaves hold fewer than k candidates visits on until they do, or all leaves are visited.

Vectors meet queries by (leaf, block of its vectors, block of its queries), with at most about ``block`` rows a side, so a
leaf that holds a third of all rows is many small tasks. What is broadcast is the tree (bounded by the sample), the leaves'
sizes and the probes. A query keeps its k best of each block, and the k best of those. Candidates are found by a matrix
product with a margin for its rounding; those that may be among the k best are scored again, each sum in the same order, so
that equal vectors have equal scores.

Where neighbours are spread over most leaves, as in noise of many dimensions, most leaves are visited, and the cost is that
of queries times rows; ``visits`` in the result says so.

Vectors that are null, all zero, or hold null or non-finite components take no part. Vectors of different lengths have no
inner product: each length is searched apart, with a tree of its own (a table of many lengths makes as many passes). Rows that
repeat a vec_id are each a query (if it is one) and a candidate of all other rows. Ties of score go to the smaller vec_id; with
fewer than k candidates all are returned; null ids and an empty table give no rows; other columns are not read. Scores are sums
in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import slices, small_batches, staged, table


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = np.argmin(((centre**2).sum(1))[None, :] - 2 * x @ centre.T, axis=1)
        for j in np.unique(own):
            centre[j] = x[own == j].mean(axis=0)
    return centre, np.argmin(((centre**2).sum(1))[None, :] - 2 * x @ centre.T, axis=1)


class Tree:
    """Inner nodes have centres and children; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, branching: int = 16, seed: int = 7):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, leaf_rows, branching)

    def _grow(self, x, leaf_rows, branching) -> int:
        k = min(branching, -(-len(x) // max(1, leaf_rows)))
        if k >= 2 and len(np.unique(x[: 4 * branching], axis=0)) >= 2:
            centre, own = _centres(x, k, self._rng)
            live = np.unique(own)
            if len(live) >= 2:
                at = len(self.nodes)
                self.nodes.append((centre[live], []))
                self.nodes[at][1].extend(self._grow(x[own == j], leaf_rows, branching) for j in live)
                return at
        self.leaves += 1
        return -self.leaves

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            centre, children = self.nodes[node]
            own = np.argmin((centre**2).sum(1)[None, :] - 2 * x[rows] @ centre.T, axis=1)
            todo += [(child, rows[own == j]) for j, child in enumerate(children) if (own == j).any()]
        return out

    def visit(self, q: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and more until they hold ``least`` of the leaves' ``rows``."""
        queue, out, held = [(0.0, self.root)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                held += 0 if rows is None else int(rows[-node - 1])
                continue
            centre, children = self.nodes[node]
            for score, child in zip((-(centre @ q)).tolist(), children, strict=True):
                heapq.heappush(queue, (score, child))
        return out


def _matrix(column, d: int) -> np.ndarray:
    """A column of arrays of ``d`` doubles, without nulls."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, d) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, d)


def _best(q: np.ndarray, v: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """(query number, candidate number, score) of each query's k largest inner products, ties to the smaller of ``ids``.

    own: for each query and candidate whether they are one row. Candidates whose product may be among the k largest are summed
    again one by one, each in the same order.
    """
    product = q @ v.T
    product[own] = -np.inf
    kth = np.partition(product, -k, axis=1)[:, -k] if k < len(v) else np.full(len(q), -np.inf)
    margin = 1e-12 * np.linalg.norm(q, axis=1) * max(1e-300, float(np.linalg.norm(v, axis=1).max())) * q.shape[1]
    row, col = np.nonzero((product >= np.where(np.isfinite(kth), kth - margin, -np.inf)[:, None]) & (product > -np.inf))
    score = np.concatenate([np.einsum("nd,nd->n", q[row[i : i + 65536]], v[col[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], score[first]


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>) of the rows that take part."""
    fine = rows.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine.withColumn("row", F.monotonically_increasing_id())


def search(rows: DataFrame, every: int = 20, k: int = 20, recall: float = 0.93, sample_rows: int = 20_000, leaves: int | None = None, probes: int = 128, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score, visits): for each row whose vec_id is a multiple of ``every``, the k nearest found."""
    small_batches(rows.sparkSession)
    fine = staged(usable(rows), "vectors")
    found = None
    for r in fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
        one = _search(fine.where(F.size("v") == r.d), r.d, r.n, every, k, recall, sample_rows, leaves, probes, block)
        found = one if found is None else found.unionByName(one)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int") if found is None else found


def _smallest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` of the n ``rows`` with the smallest hash. All but about twice as many are left out before they are sorted, so
    that what meets in one task is bounded whatever the number of partitions."""
    h = F.xxhash64("vec_id", "row")
    if n > 2 * most:
        # hashes are spread evenly over 64 bits; a third more and 200 leave no chance of too few
        rows = rows.where(h < F.lit(int((min(0.999999, (most * 4 / 3 + 200) / n) - 0.5) * 2**64)).cast("long"))
    return rows.orderBy(h, "vec_id", "row").limit(most)


def _search(fine: DataFrame, d: int, n: int, every: int, k: int, recall: float, sample_rows: int, leaves: int | None, probes: int, block: int) -> DataFrame:
    spark = fine.sparkSession
    sample = _smallest(fine, n, sample_rows).select("v").toArrow()
    # leaves grow with the cube root of the rows: where neighbours are spread over most leaves, as in noise of many
    # dimensions, each query meets most leaves, and the pairs of query and leaf must not grow with the square of the rows
    wanted = max(1, min(sample.num_rows // 8, leaves or min(4096, round(4 * n ** (1 / 3)))))
    tree = Tree(_matrix(sample.column("v"), d), max(1, sample.num_rows // wanted))
    held = spark.sparkContext.broadcast(tree)

    def file(batches):
        for batch in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(held.value.file(_matrix(batch.column("v"), d)), pa.int64())], ["row", "vec_id", "v", "leaf"])

    filed = staged(fine.select("row", "vec_id", "v").mapInArrow(file, "row long, vec_id long, v array<double>, leaf long"), "filed")
    queries = filed.where(F.col("vec_id") % every == 0)

    # --- calibration: true neighbours of a bounded set of queries
    probe = _smallest(queries, queries.count(), probes).select("row", "v").toArrow()
    probe_rows, probe_v = probe.column("row").to_numpy(), _matrix(probe.column("v"), d) if probe.num_rows else np.zeros((0, d))

    def nearest(batches):
        for batch in slices(batches, 4096):
            ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            q, at, score = _best(probe_v, _matrix(batch.column("v"), d), probe_rows[:, None] == batch.column("row").to_numpy()[None, :], ids, k)
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "vec_id": pa.array(ids[at]), "leaf": pa.array(leaf[at]), "score": pa.array(score)})

    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = filed.mapInArrow(nearest, "q int, vec_id long, leaf long, score double").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).groupBy("q").agg(F.collect_list("leaf").alias("leaves")).collect() if probe.num_rows else []
    needed = []
    for row in true:
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visit(probe_v[row.q], tree.leaves))}
        needed += [place[leaf] for leaf in row.leaves]
    visits = int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1

    # --- search
    sizes = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        sizes[r.leaf] = r["count"]

    def bins(batches):
        for batch in slices(batches):
            out = [held.value.visit(q, visits, sizes, k + 1) for q in _matrix(batch.column("v"), d)]
            at = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("vec_id").take(at), batch.column("v").take(at), pa.array([b for x in out for b in x], pa.int64())], ["query", "query_id", "q", "leaf"])

    asked = staged(queries.select("row", "vec_id", "v").mapInArrow(bins, "query long, query_id long, q array<double>, leaf long"), "asked")
    # one row a leaf, of which there are as many as the tree has
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    dealt = F.broadcast(staged(blocks(filed, "nv").join(blocks(asked, "nq"), "leaf"), "leaf-blocks"))
    left = filed.join(dealt, "leaf").select("row", "vec_id", "v", "leaf", F.pmod(F.xxhash64("row"), F.col("nv")).alias("bv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)).alias("bq"))
    right = asked.join(dealt, "leaf").select("query", "query_id", "q", "leaf", F.pmod(F.xxhash64("query"), F.col("nq")).alias("bq"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv").cast("long") - 1)).alias("bv"))

    def best_of(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = v.column("vec_id").to_numpy(), v.column("row").to_numpy()
        asks = q.column("query").to_numpy()
        at, col, score = _best(_matrix(q.column("q"), d), _matrix(v.column("v"), d), asks[:, None] == own[None, :], ids, k)
        return pa.table({"query": asks[at], "query_id": q.column("query_id").to_numpy()[at], "vec_id": ids[col], "row": own[col], "score": score})

    keys = ["leaf", "bv", "bq"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(best_of, "query long, query_id long, vec_id long, row long, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(visits).alias("visits"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
