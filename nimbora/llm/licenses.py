"""License scan: places of base phrases, and an exact containment join of text blocks with
license notices. Column functions and joins only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels. Fixed values.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Characters that separate words once A-Z are lower-cased. Fixed value.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices to look for: public wording of common licenses.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)
THRESHOLD = 0.9
#: A block is a run of so many words, and blocks start every half block, so that each run of up
#: to half a block lies whole in one of them.
BLOCK = 64


def normal_text(text: Column) -> Column:
    """Words of the text with one space before, between and after them; one space if none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(F.coalesce(lower, F.lit("")), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def word_list(normal: Column) -> Column:
    return F.filter(F.split(F.trim(normal), " "), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among the words, from 0."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(1))
    return F.filter(starts, lambda i: F.slice(words, i + 1, len(parts)) == _strings(parts))


def notice_index(docs_words: DataFrame, notices, threshold: float) -> DataFrame:
    """(token, place, n, need, label, tokens) for the prefix tokens of each notice.

    Tokens of a notice are ordered by the number of documents that hold them, rarest first, over
    all documents. A block that holds `need` of `n` tokens holds one of the first n - need + 1.
    `docs_words` has the distinct notice words of each document. The result has as many rows as
    the notices have words, whatever the input.
    """
    spark = docs_words.sparkSession
    rows = [(i, label, w) for i, (label, words) in enumerate(notices) for w in sorted(set(words.split(" ")))]
    tokens = spark.createDataFrame(rows, "notice int, label string, token string")
    seen = docs_words.select(F.explode("vocabulary").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("documents")
    )
    order = Window.partitionBy("notice").orderBy(F.coalesce("documents", F.lit(0)), "token")
    whole = Window.partitionBy("notice")
    placed = tokens.join(F.broadcast(seen), "token", "left").select(
        "notice", "label", "token", F.row_number().over(order).alias("place"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sort_array(F.collect_list("token").over(whole)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    need = F.ceil(F.col("n") * F.lit(threshold)).cast("int")
    return placed.withColumn("need", need).filter(F.col("place") <= F.col("n") - F.col("need") + 1)


def scan(
    docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD, block: int = BLOCK,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels,
    score.

    Null and empty texts have no words, no places and the score 0. A label of a notice is added
    where a block of words holds at least `threshold` of the notice's distinct words; the score
    is the largest such share, 1 where a base phrase stands. Ties need no order, since labels are
    sorted sets; repeated rows are answered each for itself; very long texts are many blocks, of
    at least twice the words of the longest notice; an empty table gives no rows. Other columns
    are not read.

    Documents are read twice: once to count the notices' words, once to scan.
    """
    block = max(block, *(2 * len(words.split(" ")) for _, words in notices))
    vocabulary = _strings(sorted({w for _, words in notices for w in words.split(" ")}))
    normal = docs.select(F.col(key).alias("key"), normal_text(F.col(text)).alias("normal"))
    counted = normal.select(F.array_intersect(word_list(F.col("normal")), vocabulary).alias("vocabulary"))
    # A row for each prefix word of a notice: bounded by the notices.
    index = notice_index(counted, notices, threshold).collect()
    spark = docs.sparkSession
    fields = "token string, place int, n int, need int, label string, tokens array<string>"
    prefixes = spark.createDataFrame(
        [(r["token"], r["place"], r["n"], r["need"], r["label"], r["tokens"]) for r in index], fields
    )
    prefix_words = _strings(sorted({r["token"] for r in index}))
    least = min(r["need"] for r in index)

    scanned = _base(normal).withColumn(
        "blocks", _blocks(F.col("words"), prefix_words, vocabulary, least, block)
    )
    rows = scanned.drop("words", "normal").withColumn("row", F.monotonically_increasing_id())
    one = rows.withColumn("block", F.explode_outer("blocks")).drop("blocks")
    tokens = one.withColumn("token", F.explode_outer(F.array_intersect(F.col("block"), prefix_words)))
    # Positional filter: of the notice, what follows the shared token in the order; of the block,
    # all its notice words. Both must still leave room for `need` shared words.
    room = (F.least(F.col("n") - F.col("place") + 1, F.size("block")) + F.col("place") - 1) >= F.col("need")
    shared = F.size(F.array_intersect(F.col("block"), F.col("tokens")))
    met = tokens.join(F.broadcast(prefixes), "token", "left")
    hit = room & (F.size("block") >= F.col("need")) & (shared >= F.col("need"))
    found = met.select(
        "row", "key", "n_words", "places", "base", F.when(hit, F.col("label")).alias("label"),
        F.when(hit, shared / F.col("n")).alias("share"),
    )
    grouped = found.groupBy("row").agg(
        F.first("key").alias("key"),
        F.first("n_words").alias("n_words"),
        F.first("places").alias("places"),
        F.first("base").alias("base"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("share"),
    )
    has_base = F.size("places") > 0
    return grouped.select(
        "key",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", "labels")), ",").alias("labels"),
        F.when(has_base, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _base(normal: DataFrame) -> DataFrame:
    """(key, normal, words, n_words, places, base): the base phrases of every text. Word places
    are only looked for in texts that hold a phrase."""
    with_words = normal.withColumn("words", word_list(F.col("normal")))
    empty = F.array().cast("array<int>")
    holds = [F.contains("normal", F.lit(f" {phrase} ")) for phrase, _ in BASE_PHRASES]
    places = [F.when(h, _places(F.col("words"), p)).otherwise(empty) for h, (p, _) in zip(holds, BASE_PHRASES)]
    labels = [F.when(h, F.lit(label)) for h, (_, label) in zip(holds, BASE_PHRASES)]
    return with_words.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "places": F.concat(*places),
            "base": F.array_compact(F.array(*labels)),
        }
    )


def _blocks(words: Column, prefix_words: Column, vocabulary: Column, least: int, block: int) -> Column:
    """The notice words of each block that has enough of them and one of the prefix words; null
    for texts without any prefix word."""
    step = block // 2
    last = F.greatest(F.size(words) - 1 - step, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    cut = F.transform(starts, lambda i: F.array_intersect(F.slice(words, i + 1, block), vocabulary))
    kept = F.filter(cut, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, prefix_words))
    return F.when(F.arrays_overlap(words, prefix_words), kept)
