"""The registered queries of this package: thin, one per operator, over whole tables."""

import zlib

from pyspark.sql import functions as F

from nimbora.llm import (
    credentials, inner_product, language, licenses, multi_index, personal_data, pieces, repeats, spelling, toxicity,
)
from nimbora.llm.near_dedup import near_duplicates
from nimbora.llm.ngrams import fold
from nimbora.llm.packing import pack
from nimbora.llm.token_files import read_token_files, write_token_files
from nimbora.session import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pack(docs, vocabulary("word_bpe_49k.json"), 1).withColumnRenamed("key", "doc_id")


def token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    return read_token_files(spark, path).withColumnRenamed("key", "doc_id")


def near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, shingle=4, least=80).withColumnRenamed("key", "doc_id")


def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.with_language(docs.drop("lang"), model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def personal_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.train(docs)).withColumnRenamed("key", "doc_id")


def license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def nearest_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.search(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def largest_products(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return inner_product.search(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def piece_segmentations(spark, sf_dir):
    """The best segmentations of every document, and what each decodes to."""
    docs = table(spark, sf_dir, "documents")
    found = pieces.encode(docs, vocabulary("piece_bpe_32k.model"), decoded=True)
    return found.withColumnRenamed("key", "doc_id")


def planted_period(key, words):
    """The words of one text in ten with a periodic tail, as the contract of op11 asks."""
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * -(-(n - a) // len(period)))[: n - a]


def periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = repeats.periodic_runs(docs, rewrite=planted_period)
    # Runs come by start, then period, so the first of the greatest length / period wins ties.
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    longer = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    best = F.aggregate("runs", none, lambda a, b: F.when(longer(a, b), b).otherwise(a))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def letter_runs(docs):
    """(word): the letter runs of all texts in lower case, those that op12's contract names without
    the code point it names. A null doc_id names none."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([A-Za-zÀ-ÿ]+)"), 1)
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower.alias("word"))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "word").cast("binary"))
    words = words.select("word", F.when(F.col("doc_id").isNotNull(), h).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    return words.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("word")).alias("word"))


def spelling_variants(spark, sf_dir):
    words = letter_runs(table(spark, sf_dir, "documents")).filter(F.length("word") >= 5)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return spelling.spelling_variants(counts)


def linked_credentials(spark, sf_dir):
    found = credentials.linked_credentials(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *(number(kind).alias(f"n_{kind}") for kind in credentials.BASE_KINDS),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )
