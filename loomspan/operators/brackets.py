"""Overlap brackets: tokens, pairing, alignment edges, candidate sets, components and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.graph import components_by_file

TOKEN = r"\(\(.*?(?:\)\)|$)|\[[2-9]?|[2-9]?\$?\]"


def tokens(content: Column) -> Column:
    """SCF-01: brackets of a line: array<struct<char_offset, kind, index>>.

    ``((...))`` is skipped (to the line's end if open), ``<<...>>`` is not; a digit from 2 to 9 after ``[`` or before ``]`` or
    ``$]`` is the index; ``$]`` closes by force. One regular expression finds comments and brackets in turn, another each with the
    text before it; one pass over both adds up the lengths.
    """
    found = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))
    pieces = F.regexp_extract_all(content, F.lit(rf"[\s\S]*?(?:{TOKEN})"), F.lit(0))
    kind = lambda t: F.when(t.startswith("["), "Open").when(F.contains(t, F.lit("$")), "CloseForced").otherwise("Close")
    none = F.array().cast("array<struct<char_offset:int,kind:string,index:int>>")

    def step(s, x):
        one = F.struct((s.at + x.n - F.length(x.t)).alias("char_offset"), kind(x.t).alias("kind"), F.regexp_extract(x.t, "([2-9])", 1).try_cast("int").alias("index"))
        return F.struct((s.at + x.n).alias("at"), F.when(x.t.startswith("("), s.out).otherwise(F.concat(s.out, F.array(one))).alias("out"))

    both = F.zip_with(pieces, found, lambda p, t: F.struct(F.length(p).alias("n"), t.alias("t")))
    return F.coalesce(F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s.out), none)


def edges(opens: DataFrame, columns: int = 2, distance: int = 5) -> DataFrame:
    """JON-05: for each open bracket (file, id, speaker, line, column, char_offset) that doesn't open its content, the nearest
    earlier one of another speaker within ``distance`` lines whose column differs by at most ``columns``. The join is by equal
    file and band of ``distance`` lines."""
    bucket = F.floor(F.col("line") / distance)
    a = opens.where("char_offset > 0").withColumn("bucket", F.explode(F.array(bucket, bucket - 1))).alias("a")
    b = opens.withColumn("bucket", bucket).alias("b")
    near = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("b.id") < F.col("a.id")) & (F.col("a.line") - F.col("b.line")).between(0, distance) & (F.abs(F.col("a.column") - F.col("b.column")) <= columns) & (F.col("a.speaker") != F.col("b.speaker")))
    return near.groupBy(F.col("a.file").alias("file"), F.col("a.id").alias("id")).agg(F.max(F.struct(F.col("b.id").alias("target"), F.abs(F.col("a.column") - F.col("b.column")).alias("column_delta"), (F.col("a.line") - F.col("b.line")).alias("line_distance"))).alias("m")).select("file", "id", "m.*")


def overlapping(pairs: DataFrame, lines: int = 20, close: int = 2, slack: float = 0.2) -> DataFrame:
    """JON-06: pairs (file, pair, speaker, line, index, t0, t1) that may be one overlap: within ``lines``, other speaker, equal
    index (null equals null), and meeting in time with ``slack`` or within ``close`` lines. The band is cut into buckets of
    ``lines``, so the join is by equal file and bucket."""
    b = F.floor(F.col("line") / lines)
    left = pairs.withColumn("bucket", F.explode(F.array(b, b - 1))).alias("a")
    right = pairs.withColumn("bucket", b).alias("b")
    meets = (F.col("a.t0") < F.col("b.t1") + slack) & (F.col("b.t0") < F.col("a.t1") + slack)
    on = (F.col("a.file") == F.col("b.file")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.index").eqNullSafe(F.col("b.index")) & (F.col("b.pair") < F.col("a.pair"))
    gap = F.abs(F.col("a.line") - F.col("b.line"))
    return left.join(right, on).where((F.col("a.speaker") != F.col("b.speaker")) & (gap <= lines) & (meets | (gap <= close))).select(F.col("a.file").alias("file"), F.col("a.pair").alias("a"), F.col("b.pair").alias("b"))


def aligned(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """JON-07: links (file, a, b) between the pairs (file, pair, open_id, speaker, index) that an edge (file, id, target) ties:
    both open ids are known, speakers differ, indices are equal (null equals null)."""
    p = pairs.select("file", "pair", "open_id", "speaker", "index")
    a = p.withColumnsRenamed({"pair": "a", "open_id": "id", "speaker": "sa", "index": "ia"})
    b = p.withColumnsRenamed({"pair": "b", "open_id": "target", "speaker": "sb", "index": "ib"})
    return edge.select("file", "id", "target").join(a, ["file", "id"]).join(b, ["file", "target"]).where((F.col("sa") != F.col("sb")) & F.col("ia").eqNullSafe(F.col("ib"))).select("file", "a", "b")


def marked_text(line: Column, mark: str) -> Column:
    """SCF-10, SCF-09: the text from the line's first such opening mark to its close, or to the line's end: lower case, without
    breath marks and overlap marks, only letters, digits, apostrophes and single blanks. Null without a mark."""
    close = {"⌈": "⌉", "⌊": "⌋"}[mark]
    inner = F.regexp_extract(line, f"{mark}[2-9]?([^{close}]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(inner), "&=in|&=ex|&=tsk|[⌈⌉⌊⌋]", ""), r"[^\p{L}\p{N}\s']", "")
    return F.when(F.contains(line, F.lit(mark)), F.trim(F.regexp_replace(bare, r"\s+", " ")))


def sets_of(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """ITR-01, WIN-11, ITR-02: overlap sets with roles: linked pairs are a set; the kth pair of a speaker in it goes to its
    kth sub-set; the lowest pair of a sub-set, alone or not, is top, the others bottom. The real index is a pair's own less
    one, else that of the top, else 0."""
    comp = components_by_file(links).withColumnsRenamed({"node": "pair", "root": "set"})
    # the windows are within a file, so its rows are brought together once
    p = pairs.join(comp, ["file", "pair"], "left").withColumn("set", F.coalesce("set", F.col("pair").cast("long"))).repartition("file")
    p = p.withColumn("nth", F.row_number().over(Window.partitionBy("file", "set", "speaker").orderBy("pair")))
    first = F.first(F.struct("pair", "index")).over(Window.partitionBy("file", "set", "nth").orderBy("pair"))
    p = p.withColumn("top", first)
    role = F.when(F.col("pair") == F.col("top.pair"), "top").otherwise("bottom")
    name = F.concat_ws(":", F.col("file").cast("string"), F.lpad(F.col("set").cast("string"), 12, "0"))
    return p.select("file", "pair", "speaker", "index", name.alias("set"), "nth", role.alias("role"), F.coalesce(F.col("index") - 1, F.col("top.index") - 1, F.lit(0)).cast("int").alias("real_index"))


def shown_index(real_index: Column) -> Column:
    """SCF-24: the index that is written, counted from 1 and starting anew after 9; null where it is 1, which is not written."""
    return F.when(real_index % 9 > 0, real_index % 9 + 1)


def confidence(opens: DataFrame, edge: DataFrame) -> DataFrame:
    """EXP-04: Original if indexed; High at either end of an edge; Medium if its real index occurs twice among the file's opening and
    closing brackets; Low; NeedsReview without a role. ``opens``: file, id, index, role, real_index, closed."""
    with_edge = edge.select("file", F.explode(F.array("id", "target")).alias("id")).distinct().withColumn("edge", F.lit(True))
    held = F.when(F.col("role").isNotNull(), 1 + F.col("closed").cast("int"))
    n = F.sum(held).over(Window.partitionBy("file", "real_index"))
    level = F.when(F.col("index").isNotNull(), "Original").when(F.col("role").isNull(), "NeedsReview").when(F.col("edge"), "High").when(F.col("n") >= 2, "Medium").otherwise("Low")
    return opens.withColumn("n", n).join(with_edge, ["file", "id"], "left").withColumn("confidence", level).drop("n", "edge")


def review(levels: DataFrame) -> DataFrame:
    """AGG-21: brackets by confidence, and the share of all in the file."""
    n = levels.groupBy("file", "confidence").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("file")))
