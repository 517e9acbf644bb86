"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), where docs are what the stage before it kept, written as Parquet and read again,
and returns the columns of ``documents``, all but the last. A stage first deletes what the one before it had staged.

1. language: profiles are learned from the rows that are not held out; documents without a language (null, or no letter) go.
2. near_dedup: one document of each class of near duplicates stays, that of smallest doc_id.
3. decontaminate: documents in which a 10-word window of a benchmark item occurs go, with rows that share their doc_id.
4. mix: all documents stay; rows are put in the order of their Pfair slots (by ranges, sorted within), so the files in the
   order of their names hold the mixture.
5. tokens: encodes in the order in which the files hold the rows, which is the mixture's, and reports each document. Rows that
   were not read from files have no such place, and Spark says so.

Null texts and doc_ids, empty tables and repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common, decontaminate, language, mixing, neardup, tokens

#: Target parts of a source in the mixture; any other source has one part.
WEIGHTS = {"src0": 2}


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    profiles = language.learn(docs.where(~language.held_out()))
    return language.predict(docs, profiles).where("lang_pred <> 'und'").select(docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return neardup.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.alias("d").join(hit.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h._hit")), "left_anti")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    slots = mixing.mix(docs, WEIGHTS).groupBy("doc_id").agg(F.min("slot").alias("_slot")).withColumnRenamed("doc_id", "_id")
    joined = docs.alias("d").join(slots.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s._id")))
    place = F.col("s._slot"), F.col("d.doc_id")
    return joined.repartitionByRange(*place).sortWithinPartitions(*place).select(*(F.col(f"d.`{c}`") for c in docs.columns))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.release(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    return tokens.read_shards(tokens.write_shards(placed, path, order=("file", "nth")))


STAGES = [("language", stage_language), ("near_dedup", stage_near_dedup), ("decontaminate", stage_decontaminate), ("mix", stage_mix), ("tokens", stage_tokens)]

#: Profiles, signatures and token ids are not SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
