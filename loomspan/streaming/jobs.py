"""Job results as streams: each finished item once, the latest write wins, sessions, giving up after failures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """STR-01: the first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class Polls(StatefulProcessor):
    """The state of one job of :func:`polled`: failures in a row, files that were reported, and whether the job is over."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n int")
        self.files = handle.getMapState("files", "name string", "at long")
        self.over = handle.getValueState("over", "done boolean")

    def handleInputRows(self, key, rows, timerValues):
        (job,) = key
        if self.over.exists():
            list(rows)
            return
        n = self.failures.get()[0] if self.failures.exists() else 0
        # a batch holds a job's polls in any order
        for poll in sorted(rows, key=lambda r: r.seq):
            if not poll.ok:
                n += 1
                if n == self.limit:
                    yield Row(job=job, seq=poll.seq, kind="given_up", file=None, left=(poll.total or 0) - sum(1 for _ in self.files.keys()))
                    self._end()
                    return
                continue
            n = 0
            for f in poll.files or []:
                if f["state"] in ("done", "error") and not self.files.containsKey((f["name"],)):
                    self.files.updateValue((f["name"],), (poll.seq,))
                    yield Row(job=job, seq=poll.seq, kind=f["state"], file=f["name"], left=None)
            if poll.status in FINAL:
                yield Row(job=job, seq=poll.seq, kind=poll.status, file=None, left=None)
                self._end()
                return
        self.failures.update((n,))

    def _end(self) -> None:
        """The job's files are forgotten; that it is over is not."""
        self.over.update((True,))
        self.failures.clear()
        self.files.clear()

    def close(self) -> None:
        pass


#: States in which a job is over.
FINAL = ("completed", "failed", "cancelled", "interrupted")
POLL = "job string, seq long, ok boolean, status string, total int, files array<struct<name string, state string>>"


def polled(polls: DataFrame, limit: int = 20) -> DataFrame:
    """STR-01, STR-03: what a stream of polls of jobs (see ``POLL``) says: (job, seq, kind, file, left).

    Each file is reported once, when it is first seen done or in error; a job when it ends, or as given_up after ``limit`` failed
    polls in a row, with the number of files that were not reported. What comes after a job's end says nothing. Counters and files are
    state, so that a stream that is stopped goes on in the middle of a streak. There are no timers: with those a stream that is to
    take up what is there and end would run on. Needs the state store of RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    out = "job string, seq long, kind string, file string, left int"
    return polls.groupBy("job").transformWithState(Polls(limit), out, "Append", "None")


# --- upserts


def _fs(spark, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark, table: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> version of the last manifest of ``table`` (before a batch); empty if there is none."""
    place, fs = _fs(spark, f"{table}/manifest")
    if not fs.exists(place):
        return {}
    names = [int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()]
    names = [n for n in names if before is None or n < before]
    if not names:
        return {}
    text = spark.read.option("wholetext", True).text(f"{table}/manifest/{max(names)}").first().value
    return {int(k): v for k, v in json.loads(text).items()}


def current(spark, table: str) -> DataFrame:
    """The rows of a table that :func:`latest` keeps."""
    return spark.read.parquet(*(f"{table}/v{v}/bucket={b}" for b, v in sorted(_manifest(spark, table).items())))


def latest(spark, table: str, key: str, order: str, buckets: int = 64):
    """STR-05: a foreachBatch function that keeps, in the table at ``table``, the row of largest ``order`` of each key.

    Rows lie in ``buckets`` by a hash of their key. A batch writes anew only the buckets it has keys of, as version v<batch>, and then a
    manifest that names the version of each bucket (at most ``buckets`` entries). A batch that is run again starts from the
    manifest before it, and so gives the same table. Read it with :func:`current`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        known = _manifest(s, table, batch_id)
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        rows, old = batch, [f"{table}/v{known[b]}/bucket={b}" for b in touched if b in known]
        if old:
            rows = s.read.schema(batch.schema).parquet(*old).unionByName(batch)
        rest = [c for c in batch.columns if c != key]
        best = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("b")).select(key, *(F.col(f"b.{c}").alias(c) for c in rest))
        filed = best.select(*batch.columns, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))
        filed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{batch_id}")
        place, fs = _fs(s, f"{table}/manifest/{batch_id}")
        out = fs.create(place, True)
        out.write(bytearray(json.dumps({str(b): v for b, v in (known | dict.fromkeys(touched, batch_id)).items()}).encode()))
        out.close()

    return write


def windowed(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and ``by``, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def given_up(rows: DataFrame, limit: int = 20) -> DataFrame:
    """STR-03: jobs (job, attempt, ok) with ``limit`` failures in a row, and the attempt at which that was."""
    from pyspark.sql import Window

    w = Window.partitionBy("job").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("goods", F.sum(F.col("ok").cast("int")).over(w)).where("not ok")
    nth = island.withColumn("streak", F.row_number().over(Window.partitionBy("job", "goods").orderBy("attempt")))
    return nth.where(F.col("streak") == limit).groupBy("job").agg(F.min("attempt").alias("attempt"))


def validated(spark, folder: str, out: str, checkpoint: str, schema: str, rules):
    """STR-06: reports (file, line, code) of the rows in Parquet files that are new in ``folder`` since the last call.

    ``rules`` makes a report of a DataFrame of rows; each call takes up what the checkpoint has not seen, and ends. A file's rows
    come in one batch, and a batch that is run again writes the same folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
