"""The training-data pipeline: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes all that its predecessor kept. Null or odd values in any column, ids too, are carried along; texts that are null, empty or without letters
are rejected by the first stage. Repeated rows are copies of one document: the near-duplicate stage keeps the rows of the least id of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import common, decontaminate, language, near_dup, packing, pseudonyms
from voxelspark.llm.queries import PSEUDONYM_KEY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language scores less is rejected, as is one without letters.
LEAST_SCORE = 0.35
#: So is one of whose n-grams less than this share is in any learnable document, as in a script that was not learned, however many languages were.
LEAST_KNOWN = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = common.compact(docs.select(*COLUMNS))
    model = language.train(docs.select("doc_id", "text", "lang").where(~language.held_out(F.col("doc_id"))))
    return language.keep_identified(docs, model, LEAST_SCORE, LEAST_KNOWN)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that share a kept id, all stay: ids are unique in ``documents``."""
    docs = common.compact(docs.select(*COLUMNS))
    gone = common.materialize(near_dup.group_near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), docs.count())
    return docs.join(common.checked_broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove_contaminated(common.compact(docs.select(*COLUMNS)), items)


def replace_private_numbers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = pseudonyms.pseudonymize(common.compact(docs.select(*COLUMNS)), PSEUDONYM_KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.compact(docs.select(*COLUMNS)), packing.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark_passages", drop_benchmark_passages),
    ("pseudonyms", replace_private_numbers),
    ("packing", pack),
]
#: Neither the language model nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = common.materialize(stage(spark, docs, sf_dir))
        common.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
