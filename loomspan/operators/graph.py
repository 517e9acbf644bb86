"""Connected components of an edge list by star contraction."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoints(df: DataFrame):
    """What cuts the lineage of a DataFrame: a checkpoint in the folder of spark.checkpoint.dir (one of our own where it is unset, on one machine only)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and not spark.conf.get("spark.checkpoint.dir", None):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}")
    return lambda part: part.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``links`` (a, b): root is the smallest node that a node is linked with.

    Each round ties a node's larger neighbours, then its smaller ones, to its smallest neighbour, until no edge changes; the
    edges end as stars. Rounds are cut by checkpoints.
    """
    cut = checkpoints(links)
    edges, state = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        joined = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


#: Links that a task holds at once.
HELD = 1 << 20


def _stars(group: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(group, node, root) of the nodes of links within groups, which are numbers here: the root is the smallest node linked with."""
    _, g = np.unique(np.concatenate([group, group]), return_inverse=True)
    names, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, at = np.unique(g.astype(np.int64) * len(names) + n, return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(keys))
    while True:
        # keys are in the order of the nodes: the larger root goes to the smaller one, and all go on to where that leads
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return keys // len(names), names[keys % len(names)], names[keys[root] % len(names)]


def components_by_file(links: DataFrame, held: int = HELD) -> DataFrame:
    """(file, node, root) for the ends of ``links`` (file, a, b; both whole numbers), which never leave their file.

    A task reads the links of file after file and joins them where it reads them. Of a file with more than ``held`` links it
    joins so many at a time, and what is left of them, a link a node, goes through :func:`components`.
    """
    cut = checkpoints(links)
    names = ["file", "node", "root", "whole"]

    def run(batches):
        kept, n, split = [], 0, None

        def told(t, whole):
            files = t["file"].combine_chunks().dictionary_encode()
            codes = np.asarray(files.indices)
            g, node, root = _stars(codes, np.asarray(t["a"]), np.asarray(t["b"]))
            # groups are numbered by their codes in order, and all codes occur
            yield from pa.table([files.dictionary.take(pa.array(g)), node, root, np.full(len(node), whole)], names).to_batches(1 << 16)

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            n += batch.num_rows
            if n < held:
                continue
            t = pa.Table.from_batches(kept)
            last = t["file"][-1].as_py()
            first = t["file"].index(last).as_py()
            done, t = t.slice(0, first), t.slice(first)
            if done.num_rows:
                # rows of a file that was cut before come first
                old = pc.sum(pc.equal(done["file"], split)).as_py() or 0 if split is not None else 0
                for part, whole in ((done.slice(0, old), False), (done.slice(old), True)):
                    if part.num_rows:
                        yield from told(part, whole)
            if t.num_rows >= held:
                yield from told(t, False)
                split, t = last, t.slice(0, 0)
            kept, n = t.to_batches(), t.num_rows
        if n:
            t = pa.Table.from_batches(kept)
            old = pc.sum(pc.equal(t["file"], split)).as_py() or 0 if split is not None else 0
            for part, whole in ((t.slice(0, old), False), (t.slice(old), True)):
                if part.num_rows:
                    yield from told(part, whole)

    types = f"file {links.schema['file'].dataType.simpleString()}, node long, root long, whole boolean"
    l = links.where("file is not null and a <> b").select("file", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))  # noqa: E741
    # by a hash of the file: Spark leaves repartition("file") out where the links are a union of parts that lie by file, and then
    # coalesces the partitions of each part on its own, so a file's links would be in several tasks
    stars = cut(l.repartition(F.xxhash64("file")).sortWithinPartitions("file").mapInArrow(run, types))
    done = stars.where("whole").select("file", "node", "root")
    rest = stars.where("not whole")
    if rest.isEmpty():
        return done
    key = lambda c: F.struct("file", F.col(c).alias("node"))
    more = components(rest.select(key("node").alias("a"), key("root").alias("b")))
    return done.unionByName(more.select("node.file", "node.node", F.col("root.node").alias("root")))
