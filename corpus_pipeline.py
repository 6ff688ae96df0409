"""A training corpus from `documents`: toxicity, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Rows with null
keys pass the filters that need a key; null and empty texts have no letters and go in the second
stage; empty tables pass through all stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm import language, near_dedup, packing, personal_data, toxicity
from nimbora.llm.common import write_scratch
from nimbora.llm.queries import vocabulary

#: Documents at least this likely toxic go; languages less sure than this go.
TOXIC, LANGUAGE = 0.5, 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_score(docs, model, column="_toxic")
    return scored.filter(F.col("_toxic") < TOXIC).drop("_toxic")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    found = language.with_language(docs, model, names=("_lang", "_sure"))
    known = (F.col("_lang") != language.UNKNOWN) & (F.col("_sure") >= LANGUAGE)
    return found.filter(known).drop("_lang", "_sure")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(docs, shingle=5, least=80)
    gone = groups.filter(~F.col("kept")).select(F.col("key").alias("_key")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_key"), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.with_redaction(docs, personal_data.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), 1)
    return pieces.withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# Trained models and a randomised join have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
