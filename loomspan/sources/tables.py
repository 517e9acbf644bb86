"""The tables as transcripts: conversations are utterances, events are timed utterances, document lines are log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, idx, speaker, text)."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")


def millis(ts):
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86_400_000 + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000).cast("long")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, idx, id, speaker, start_ms, end_ms): every seventh event has no times."""
    e = read(spark, sf_dir, "events")
    start = millis(F.col("ts"))
    known = F.col("event_id") % 7 != 0
    rows = e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("speaker"),
        F.when(known, start).alias("start_ms"), F.when(known, start + F.floor(F.abs("value") * 1000).cast("long")).alias("end_ms"), "value",
    )
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("ts", "id"))).drop("ts")


#: The same in SQL, to build on.
TIMED_SQL = """e AS (SELECT user_id AS file, event_id AS id, event_type AS speaker, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END AS start_ms,
  CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) END AS end_ms, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text): documents split at line ends, lines counted from 1."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file"), "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


LINES_SQL = """l AS (SELECT doc_id AS file, source, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)"""
