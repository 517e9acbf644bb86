"""Operator 12: the prefix trie of conversations, with what sharing its nodes saves.

A conversation is an array of turns; a turn (role, text) is a 128-bit digest of both, and the digests one after the other are
the conversation's *key*. Keys are range-sorted over all conversations, ties by conv_id, so that a node of the trie, all keys
that begin with the same turns, is an interval. Each partition is swept once: the longest common prefix (LCP) of neighbouring keys
says which nodes of the stack end and which begin. What lies wholly in the partition is finished there.

The prefixes of the partition's first and last key may go on beyond it. They leave the sweep as *open* records with what the
partition knows of them, and one more sweep, over the open records alone in the order of the partitions, stitches them:
an equal prefix goes on, any other ends the stack below it. It reads a partition's first and last key, however many rows
the partition has. The ids of conversations that end at one node are hashed as they come; only a run of equal keys that
reaches a partition's edge is handed on, in pieces of ``PIECE`` ids, and SHA-256 has to read such a run in order anyway.
A node's parent is known when the parent ends, so children of finished nodes wait for it, and children of open nodes
get theirs by a join on partition and depth, keys that no node can make hot.

Turns are ordered by turn (null first), equal ones by digest; null role or text is empty; rows of a null conv_id belong to no
conversation and are left out. Repeated rows are turns. A conversation is one row of 16 bytes and a count a turn, whatever its texts. An empty table gives no nodes.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import slices, small_batches, staged, table

#: Bytes of a turn in a key; ids of a piece of a run.
TURN, PIECE = 16, 8192
CLOSED, CHILD, OPEN = 0, 1, 2
FIRST, LAST = 0, 1
NODE = "kind int, part int, side int, depth int, seq int, turn binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, tokens long, ends string, ids string"
_NAMES = [c.split(" ")[0] for c in NODE.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_TYPES = [_KINDS[c.split(" ")[1]] for c in NODE.split(", ")]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, tokens>>) of each conversation of ``rows`` (conv_id, turn, role, text), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps (ab, c) and (a, bc) apart
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    return rows.where("conv_id is not null").select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(turns: DataFrame, most: int = 3, every: int = 20) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % (most + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    base = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = turns.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    none = F.slice("turns", 1, 0)
    # the rest is cut before the join, so that the base's turns are all that the join adds
    cut = own.select("conv_id", "base", "h", F.filter("turns", lambda _, i: i >= F.col("h")).alias("rest"), none.alias("none"))
    joined = cut.join(base, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", "none"), F.lit(1), F.col("h")), F.col("rest")).alias("turns"))


def keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, key binary, tokens array<long>): the digests one after the other, and the words of each turn."""
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("key"), F.transform("turns", lambda t: t.tokens).alias("tokens"))


class Node:
    """A prefix on the stack. left: a prefix of the partition's first key, which may have begun before it."""

    __slots__ = ("children", "conv", "count", "depth", "ends", "kids", "leaves", "left", "saved", "tokens", "turn")

    def __init__(self, turn: bytes, tokens: int, depth: int, left: bool):
        self.turn, self.tokens, self.depth, self.left = turn, tokens, depth, left
        self.conv, self.count, self.children, self.leaves, self.saved, self.ends, self.kids = None, 0, 0, 0, 0, None, []

    def count_in(self, child: Node) -> None:
        self.count += child.count
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)

    def finish(self) -> None:
        """All children have ended and are added up."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.count - 1) * self.tokens

    def take(self, child: Node) -> None:
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both keys that are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    low, high = 0, n // TURN  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


class Sweep:
    """One pass over a partition's rows (conv_id, key, tokens), sorted by key and conv_id; yields records as in ``NODE``."""

    def __init__(self, part: int):
        self.part, self.stack, self.popped = part, [], []
        self.run, self.pieces, self.at_first, self.hasher, self.seq = [], [], True, None, 0

    def record(self, kind: int, node: Node, side: int, parent: int | None = None) -> tuple:
        return (kind, self.part, side, node.depth, 0, node.turn, node.conv, parent, node.count, node.children, node.leaves, node.saved, node.tokens, node.ends, None)

    def text(self) -> str:
        text = ",".join(map(str, self.run))
        self.run = []
        return text

    def piece(self, side: int, text: str) -> tuple:
        self.seq += 1
        return (OPEN, self.part, side, self.stack[-1].depth, self.seq, *[None] * 9, text)

    def fill(self):
        """A piece of the run of equal keys is full (or the run is over, with something left). Where the run began at the
        partition's first row it is handed on at once; else it is hashed, and kept in case the run reaches the last row."""
        if self.at_first:
            yield self.piece(FIRST, self.text())
        else:
            text = self.text()
            self.hasher.update(("," if self.pieces else "").encode() + text.encode())
            self.pieces.append(text)

    def pop(self, depth: int):
        """The nodes deeper than ``depth`` end."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            up = self.stack[-1]
            up.count_in(node)
            if node.left:
                self.popped.append(node)
                continue
            node.finish()
            up.take(node)
            for child in node.kids:
                yield self.record(CLOSED, child, FIRST, node.conv)
            node.kids = []
            if up.left:
                yield self.record(CHILD, node, FIRST)
            else:
                up.kids.append(node)

    def rows(self, rows):
        key = None
        for conv, now, tokens in rows:
            if now != key:
                shared = 0
                if key is None:
                    self.stack.append(Node(b"", 0, 0, True))
                else:
                    if self.run:
                        yield from self.fill()
                    if not self.at_first:
                        self.stack[-1].ends = self.hasher.hexdigest()
                    self.at_first = False
                    shared = common(key, now)
                    yield from self.pop(shared)
                for d in range(shared, len(now) // TURN):
                    self.stack.append(Node(now[d * TURN : (d + 1) * TURN], tokens[d], d + 1, key is None))
                key, self.hasher, self.pieces = now, hashlib.sha256(), []
            top = self.stack[-1]
            top.count += 1
            top.conv = conv if top.conv is None else min(top.conv, conv)
            self.run.append(conv)
            if len(self.run) == PIECE:
                yield from self.fill()
        if key is None:
            return
        if self.run:
            yield from self.fill()
        if not self.at_first:
            for text in self.pieces:
                yield self.piece(LAST, text)
        while self.stack:
            node = self.stack.pop()
            if self.stack:
                self.stack[-1].count_in(node)
            for child in node.kids:
                yield self.record(CHILD, child, LAST)
            yield self.record(OPEN, node, FIRST if node.left else LAST)
        for node in self.popped:
            yield self.record(OPEN, node, FIRST)


STITCHED = "part int, side int, upto int, depth int, up_part int, up_side int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


class Stitch:
    """One pass over the open records in the order of part, side, depth and seq; yields the nodes they are parts of."""

    def __init__(self):
        self.stack: list[tuple[Node, list]] = []

    def pop(self, depth: int):
        while len(self.stack) > depth:
            node, (part, side, upto, hasher) = self.stack.pop()
            node.finish()
            above = (None, None)
            if self.stack:
                up, place = self.stack[-1]
                up.take(node)
                above = place[0], place[1]
            ends = hasher.hexdigest() if hasher else node.ends or EMPTY
            yield (part, side, upto, node.depth, *above, node.conv, node.count, node.children, node.leaves, node.saved, ends)

    def rows(self, rows):
        now, goes_on = None, False
        for part, side, depth, seq, turn, conv, count, children, leaves, saved, tokens, ends, ids in rows:
            if seq:
                place = self.stack[depth][1]
                first = place[3] is None
                place[3] = place[3] or hashlib.sha256()
                place[3].update(("" if first else ",").encode() + ids.encode())
                continue
            if (part, side) != now:
                now, goes_on = (part, side), side == FIRST
            goes_on = goes_on and len(self.stack) > depth and self.stack[depth][0].turn == turn
            if goes_on:
                node, place = self.stack[depth]
                place[2] = part
                node.ends = ends or node.ends
            else:
                yield from self.pop(depth)
                node = Node(turn, tokens, depth, False)
                node.ends = ends
                self.stack.append((node, [part, side, part, None]))
            node.count += count
            node.conv = conv if node.conv is None else min(node.conv, conv)
            node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
        yield from self.pop(0)


def _batches(records, names, types, size: int = 4096):
    held = []
    for r in records:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _rows(batches, names):
    for batch in slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes over ``arrays`` (conv_id, key, tokens): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(arrays.sparkSession)
    opened = ["part", "side", "depth", "seq", "turn", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "tokens", "ends", "ids"]
    kinds = dict(c.split(" ") for c in STITCHED.split(", "))

    def swept(batches):
        yield from _batches(Sweep(TaskContext.get().partitionId()).rows(_rows(batches, ("conv_id", "key", "tokens"))), _NAMES, _TYPES)

    def stitched(batches):
        yield from _batches(Stitch().rows(_rows(batches, opened)), list(kinds), [_KINDS[k] for k in kinds.values()])

    ranged = arrays.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    records = staged(ranged.mapInArrow(swept, NODE), "swept")
    edges = records.where(F.col("kind") == OPEN).select(opened).repartition(1).sortWithinPartitions("part", "side", "depth", "seq")
    joined = staged(edges.mapInArrow(stitched, STITCHED), "stitched")

    # where an open node lies: its first partition and side, then the first key of each partition it goes on to
    on = F.when(F.col("upto") > F.col("part"), F.transform(F.sequence(F.col("part") + 1, F.col("upto")), lambda p: F.struct(p.alias("part"), F.lit(FIRST).alias("side"))))
    places = joined.select("conv_id", F.col("depth").alias("up"), F.explode(F.concat(F.array(F.struct("part", "side")), F.coalesce(on, F.array().cast("array<struct<part:int,side:int>>")))).alias("p")).select(F.col("p.part").alias("part"), F.col("p.side").alias("side"), F.col("up") + 1, F.col("conv_id").alias("parent_conv_id"))
    places = places.toDF("part", "side", "depth", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    children = records.where(F.col("kind") == CHILD).drop("parent_conv_id").join(places, ["part", "side", "depth"]).select(columns)
    above = joined.select(F.col("part").alias("up_part"), F.col("side").alias("up_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    edge_nodes = joined.join(above, ["up_part", "up_side", "depth"], "left").select(columns)
    nodes = records.where(F.col("kind") == CLOSED).select(columns).unionByName(children).unionByName(edge_nodes)
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    return trie(staged(keyed(rebuilt(turn_arrays(rows))), "turn-arrays"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tok, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, m, tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS side, k, m, tok FROM c JOIN o ON o.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, 1, k, m, tok FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
s AS (SELECT conv_id, row_number() OVER w AS d, tok, string_agg(m, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, k)),
p AS (SELECT conv_id, d, path, tok FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
fin AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path),
n AS (SELECT d, path, left(path, length(path) - 32) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(tok) AS own FROM p GROUP BY d, path),
kids AS (SELECT up, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
sub AS (SELECT left(path, 32 * CAST(e AS INTEGER)) AS path, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum(own) AS saved FROM (SELECT n.*, kids.kids, unnest(range(0, d + 1)) AS e FROM n LEFT JOIN kids ON kids.up = n.path) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(kids.kids, 0) AS BIGINT) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(fin.ids, '')) AS ends_sha256
FROM n JOIN sub ON sub.path = n.path LEFT JOIN kids ON kids.up = n.path LEFT JOIN n u ON n.d > 0 AND u.path = n.up LEFT JOIN fin ON fin.path = n.path
"""
