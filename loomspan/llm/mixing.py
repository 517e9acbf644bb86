"""Operator 10 [native]: mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_size`` characters, in the order of doc_id; a document belongs to the block in
which it starts. With target weight w, block i of a source (i = 1, 2, ...) is released at slot floor((i-1)/w) and due
by slot ceil(i/w); one slot takes one block, and of the released blocks the one due first goes next. While a source
lasts, the blocks it has had differ from weight x slots by less than one.

Weights are whole parts of a period (the sum of all sources' parts), so the schedule repeats after a period. Sources of equal
parts are scheduled as one *lane* whose blocks they take in turn, by name: the windows of the lane's blocks lie within those of
the source's own, so each source still keeps to its releases and deadlines. Lanes are as many as there are different parts, at
most the weights given and one, whatever the number of sources. A period's timetable (lane, number in the lane, slot) is made
slot by slot inside one expression, ``span`` slots a row; a longer period takes more rows, each going on where the last ended,
so that no task holds more than a span. It is joined by lane and number; Spark broadcasts it while it is small.

A block's number needs the characters before it in its source. They are summed over ranges of (source, doc_id), then the
ranges' totals; a source with a third of all rows is spread over many ranges. All documents are kept: the slots of a source
that has run out stay empty, so the others keep their proportions.

Nulls: a null source is a source of its own, null doc_ids come first, a null text has no characters; a very long text is one
document of one block. Repeated doc_ids keep their rows. Sources without a weight get ``default_parts``; weights of sources that
the table lacks have no effect. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import staged, table


def _div(a: Column, b) -> Column:
    """Whole-number division: exact where doubles are not."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _up(a: Column, b) -> Column:
    return _div(a + b - 1, b)


def schedule(parts: list[int], done: list[int], first: int, n: int, block: int = 512) -> Column:
    """struct<done, out>: the owners of ``n`` slots from ``first`` on, by earliest deadline among the released blocks.

    parts: of each lane, the period being their sum; done: blocks each lane has had before. out: array<array<struct<k, nth>>>,
    the lane and its block's number, in arrays of ``block`` slots, which bounds what is copied as they grow.
    """
    period = sum(parts)
    longs = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs))
    p = longs(parts)

    def step(state, slot):
        # next block of lane k: number done[k] + 1; released at done * period div part, due at ceil((done + 1) * period / part)
        due = F.transform(
            p,
            lambda part, k: F.when(_div(F.get(state.done, k) * period, part) <= slot, F.struct(_up((F.get(state.done, k) + 1) * period, part).alias("due"), k.cast("int").alias("k"))),
        )
        owner = F.array_min(F.filter(due, lambda d: d.isNotNull())).k
        mine = F.struct(owner.alias("k"), F.get(state.done, owner).alias("nth"))
        return F.struct(F.transform(state.done, lambda d, k: d + (k == owner).cast("long")).alias("done"), F.concat(state.out, F.array(mine)).alias("out"))

    def run(state, at):
        none = F.array().cast("array<struct<k:int,nth:bigint>>")
        inner = F.aggregate(F.sequence(at, F.least(at + block, F.lit(first + n)) - 1), F.struct(state.done.alias("done"), none.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x.done.alias("done"), F.concat(state.out, F.array(x.out)).alias("out"))), F.lit(0))

    start = F.struct(longs(done).alias("done"), F.array().cast("array<array<struct<k:int,nth:bigint>>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"), F.lit(block).cast("long")), start, run)


def timetable(spark: SparkSession, parts: list[int], span: int = 1 << 18) -> DataFrame:
    """(k, nth, offset): the slot, within the period, of the nth block (from 0) of lane k."""
    if min(parts) < 1:
        raise ValueError("weights are positive whole parts")
    period, done, out = sum(parts), [0] * len(parts), None
    for first in range(0, period, span):
        row = spark.range(1).select(schedule(parts, done, first, min(span, period - first)).alias("s"))
        if period > span:
            row = staged(row, "mix-span")
            done = row.select("s.done").first()[0]
        slots = row.select(F.posexplode(F.flatten("s.out")).alias("at", "o")).select("o.k", "o.nth", (F.col("at") + first).cast("long").alias("offset"))
        out = slots if out is None else out.unionByName(slots)
    return out


def running(rows: DataFrame, by: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the earlier rows of equal ``by``, in ``order``, which starts with it.

    Summed over ranges of ``order``, then the ranges' totals, so that no value of ``by`` has to fit a task.
    """
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and value of by: at most ranges + values of them
    totals = ranged.groupBy("_part", by).agg(F.sum(value).alias("n")).select("_part", by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    held = ranged.withColumn("own", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("r")
    joined = held.join(totals.alias("t"), (F.col("r._part") == F.col("t._part")) & F.col(f"r.{by}").eqNullSafe(F.col(f"t.{by}")))
    return joined.select(*(f"r.{c}" for c in rows.columns), (F.col("base") + F.col("own")).alias("before"))


def placed(docs: DataFrame, block_size: int) -> DataFrame:
    """(doc_id, source, n_chars, _row, block): block from 0, by characters before the document in its source."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", n.alias("n_chars"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    return running(rows, "source", order, "n_chars", "mix-ranges").withColumn("block", _div(F.col("before"), block_size)).drop("before")


def lanes(docs: DataFrame, weights: dict[str | None, int], default_parts: int) -> DataFrame:
    """(source, parts, member): each source with its parts and its place among the sources of equal parts."""
    found = docs.select("source").distinct()
    if weights:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, parts long")
        found = found.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.coalesce("parts", F.lit(default_parts).cast("long")).alias("parts"))
    else:
        found = found.withColumn("parts", F.lit(default_parts).cast("long"))
    order = [F.asc("parts"), F.asc_nulls_first("source")]
    return running(found.withColumn("one", F.lit(1)), "parts", order, "one", "mix-sources").select("source", "parts", F.col("before").alias("member"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_size: int = 1 << 16, default_parts: int = 1, span: int = 1 << 18) -> DataFrame:
    """(doc_id, source, n_chars, block, release, deadline, slot, _row); ``slot`` orders the mixture."""
    if min([default_parts, *(weights or {}).values()]) < 1:
        raise ValueError("weights are positive whole parts")
    spark = docs.sparkSession
    sources = staged(lanes(docs, weights or {}, default_parts), "mix-lanes")
    # a row for each different number of parts: at most the weights given and one
    by_parts = sources.groupBy("parts").agg(F.count("*").alias("members")).orderBy("parts").collect() or [{"parts": 1, "members": 1}]
    total = [r["parts"] * r["members"] for r in by_parts]
    divisor, period = gcd(*total), sum(total)
    table_ = staged(timetable(spark, [x // divisor for x in total], span), "mix-timetable")
    kinds = spark.createDataFrame([(r["parts"], k, r["members"], x // divisor) for k, (r, x) in enumerate(zip(by_parts, total, strict=True))], "parts long, k int, members long, turns long")
    known = sources.join(F.broadcast(kinds), "parts").alias("l")
    p = placed(docs, block_size).alias("p").join(known, F.col("p.source").eqNullSafe(F.col("l.source"))).select("p.*", "parts", "k", "turns", (F.col("block") * F.col("members") + F.col("member")).alias("n"))
    out = p.withColumn("nth", F.col("n") % F.col("turns")).join(table_, ["k", "nth"])
    block, parts = F.col("block"), F.col("parts")
    return out.select(
        "doc_id", "source", "n_chars", "block", _div(block * period, parts).alias("release"), _up((block + 1) * period, parts).alias("deadline"),
        (_div(F.col("n"), F.col("turns")) * (period // divisor) + F.col("offset")).alias("slot"), "_row",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), {"src0": 2}).drop("_row")


#: For up to two lanes, as the query has: parts 1 (lane 0, or the only one) and 2.
ORACLE = r"""
WITH RECURSIVE src AS (SELECT source, CASE WHEN source = 'src0' THEN 2 ELSE 1 END AS parts FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT *, row_number() OVER (PARTITION BY parts ORDER BY source NULLS FIRST) - 1 AS member, count(*) OVER (PARTITION BY parts) AS members FROM src),
k AS (SELECT DISTINCT parts, members, parts * members AS total FROM l),
g AS (SELECT CAST(sum(total) AS BIGINT) AS period, CASE WHEN count(*) = 1 THEN max(total) ELSE gcd(min(total), max(total)) END AS d FROM k),
q AS (SELECT period, period // d AS p, (SELECT total FROM k ORDER BY parts LIMIT 1) // d AS a_turns, (SELECT total FROM k ORDER BY parts LIMIT 1 OFFSET 1) // d AS b_turns FROM g),
st(slot, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT slot + 1, a + CASE WHEN o = 0 THEN 1 ELSE 0 END, b + CASE WHEN o = 1 THEN 1 ELSE 0 END FROM (SELECT st.*, p,
  CASE WHEN b_turns IS NULL OR b * p // b_turns > slot THEN 0 WHEN a * p // a_turns > slot THEN 1 WHEN ((a + 1) * p + a_turns - 1) // a_turns <= ((b + 1) * p + b_turns - 1) // b_turns THEN 0 ELSE 1 END AS o FROM st, q) WHERE slot + 1 < p),
own AS (SELECT slot, a, b, CASE WHEN b_turns IS NULL OR b * p // b_turns > slot THEN 0 WHEN a * p // a_turns > slot THEN 1 WHEN ((a + 1) * p + a_turns - 1) // a_turns <= ((b + 1) * p + b_turns - 1) // b_turns THEN 0 ELSE 1 END AS o FROM st, q),
t AS (SELECT slot AS place, o, CASE WHEN o = 0 THEN a ELSE b END AS nth FROM own),
d AS (SELECT doc_id, source, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents),
b AS (SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS block FROM d),
x AS (SELECT b.*, l.parts, block * members + member AS n, CASE WHEN l.parts = (SELECT min(parts) FROM k) THEN 0 ELSE 1 END AS o FROM b JOIN l ON b.source IS NOT DISTINCT FROM l.source),
y AS (SELECT x.*, q.*, CASE WHEN o = 0 THEN a_turns ELSE b_turns END AS turns FROM x, q)
SELECT doc_id, source, n_chars, block, block * period // parts AS release, ((block + 1) * period + parts - 1) // parts AS deadline, n // turns * p + place AS slot FROM y JOIN t ON t.o = y.o AND t.nth = n % turns
"""
