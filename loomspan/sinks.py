"""Results as files: tables, documents, lists and reports, written by Spark's committer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(table: DataFrame, path: str, sep: str = "\t") -> None:
    """SNK-04 to SNK-08, SNK-16: a table with its header, nulls as empty fields."""
    table.write.option("sep", sep).option("header", "true").option("emptyValue", "").csv(path)


def documents(docs: DataFrame, path: str) -> None:
    """SNK-01, SNK-15: (file, text), each text, ended by a line end, in a folder file=... of its own; what was read is never
    written over."""
    docs.select(F.col("file").cast("string").alias("file"), F.regexp_replace("text", "\n$", "").alias("text")).write.partitionBy("file").text(path)


def file_lists(files: DataFrame, path: str) -> None:
    """SNK-11: paths (collection, path): all in one list, and a list for each collection."""
    files.select("path").write.text(f"{path}/all")
    files.select("collection", "path").write.partitionBy("collection").text(f"{path}/by-collection")


def document_json(u: DataFrame, meta: DataFrame) -> DataFrame:
    """SNK-02: (file, json): a file's columns of ``meta`` with its utterances (file, utterance, ...) in order."""
    held = F.sort_array(F.collect_list(F.struct("utterance", *(c for c in u.columns if c not in ("file", "utterance")))))
    joined = meta.join(u.groupBy("file").agg(held.alias("utterances")), "file", "left")
    return joined.select("file", F.to_json(F.struct(*meta.columns, "utterances")).alias("json"))


def diagnostics(found: DataFrame) -> DataFrame:
    """SNK-03: problems (file, line, problem) as lines ``file:line: problem``."""
    return found.select(F.format_string("%s:%d: %s", F.col("file").cast("string"), F.col("line").cast("int"), F.col("problem")).alias("text"))


def markdown(table: DataFrame) -> Column:
    """SNK-12: a row of ``table`` as a row of a Markdown table; bars in values are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |"))


def markdown_report(table: DataFrame, title: str, *order) -> DataFrame:
    """SNK-12: (nth, text): a report of aggregates as Markdown; ``table`` is small, one row a group."""
    head = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    rows = table.sparkSession.createDataFrame(list(enumerate(head)), "nth long, text string")
    from pyspark.sql import Window

    body = table.select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).cast("long").alias("nth"), markdown(table).alias("text"))
    return rows.unionByName(body)


def audit_json(warnings: DataFrame) -> DataFrame:
    """SNK-13: one row (json): totals, warnings by collection, and the files of each code, from (collection, file, code)."""
    pairs = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v))))
    summary = warnings.agg(F.struct(F.count("*").alias("warnings"), F.countDistinct("file").alias("files")).alias("summary"))
    by = warnings.groupBy("collection").agg(F.count("*").alias("n")).agg(pairs("collection", "n").alias("collections"))
    files = warnings.groupBy("code").agg(F.array_sort(F.collect_set("file")).alias("f")).agg(pairs("code", "f").alias("files_by_warning"))
    return summary.crossJoin(by).crossJoin(files).select(F.to_json(F.struct("summary", "collections", "files_by_warning")).alias("json"))


def put_batches(rows: DataFrame, put, size: int = 1000) -> None:
    """SNK-14: rows (task, engine, version, key, value) handed to ``put(key_of_group, [(key, value), ...])`` in batches of one group.

    ``put`` runs on the executors and must bear being called again for a batch, as a lost task is run anew.
    """

    def run(part):
        held, now = [], None
        for r in part:
            group = (r.task, r.engine, r.version)
            if held and (group != now or len(held) >= size):
                put(now, held)
                held = []
            now = group
            held.append((r.key, r.value))
        if held:
            put(now, held)

    rows.repartition("task", "engine", "version", F.pmod(F.xxhash64("key"), F.lit(64))).sortWithinPartitions("task", "engine", "version", "key").foreachPartition(run)
