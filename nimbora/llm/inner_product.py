"""Exact largest inner products by norm-bucketed retrieval.

Integer vectors are grouped into buckets of similar length. The k-th best product of a query with
the longest bucket bounds its answer from below; in each other bucket that bound, divided by the
lengths, is a local cosine threshold. A bucket whose threshold is above 1 is skipped, one with a
high threshold is pruned by the coordinates where the query is largest, any other by length.
What is left is verified by its product.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import write_scratch
from nimbora.llm.vectors import (
    CANDIDATES,
    answers,
    best,
    blocks_for,
    matrix,
    meet,
    members,
    query_classes,
    usable,
)

SCALE = 1024
#: Local cosine threshold from which coordinates prune, and how many of them are used.
COORDINATES_FROM, FOCUS = 0.6, 5
EXACT = float(1 << 53)


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """floor(scale * x) of each component, x as double."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with b: exact doubles where they fit, otherwise
    Python integers, held within 64 bits."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if largest * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.astype(object)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], dtype=np.int64)


def left_over(q, q_length, bound, vectors, lengths):
    """Places in a bucket, sorted by falling length, whose product with q can reach the bound."""
    slack = 1 - 1e-9
    if bound is None or bound <= 0 or q_length == 0:
        return np.arange(len(lengths))
    threshold = bound * slack / (q_length * max(lengths[0], 1e-300))
    if threshold > 1:
        return np.arange(0)
    # Length: |q| |p| must reach the bound; lengths fall, so a prefix is left.
    place = np.arange(int(np.searchsorted(-lengths, -bound * slack / q_length, side="right")))
    if threshold < COORDINATES_FROM:
        return place
    # Coordinate f: of unit vectors with cosine t, p_f lies within
    # t q_f -+ sqrt((1 - t^2) (1 - q_f^2)), with t from the vector's own length.
    unit = q / q_length
    local = np.minimum(bound * slack / (q_length * lengths[place]), 1)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        p = vectors[place, f] / lengths[place]
        # cosine <= q_f p_f + sqrt((1 - q_f^2) (1 - p_f^2))
        reach = unit[f] * p + np.sqrt(np.maximum(0, (1 - unit[f] ** 2) * (1 - p**2)))
        keep = reach >= local - 1e-9
        place, local = place[keep], local[keep]
    return place


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Null vectors, vectors with null or non-finite components and vectors of another than the most
    common length take no part; zero vectors do, their products are 0. A query is not its own
    neighbour; ties go to the smaller id; repeated rows count once. Fewer than k other vectors:
    all of them. An empty table gives no rows. Other columns are not read. Products beyond 64 bits
    are held at their limits.
    """
    import pyarrow as pa

    given = quantised(usable(rows, key, vector), scale)
    classes, _ = write_scratch(members(given, k + 1), "classes")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    reps = classes.filter(F.col("id") == F.col("rep")).select("rep", "v", length.alias("length"))
    count = reps.count()
    head = reps.select(F.size("v").alias("s")).head(1)
    asked = quantised(usable(queries, key, vector), scale).filter(F.size("v") == (head[0]["s"] if head else 0))
    qreps, asked = query_classes(asked)
    qreps, _ = write_scratch(qreps, "queries")
    n_queries = qreps.count()

    buckets = blocks_for(count, CANDIDATES)
    shares = [1 - i / buckets for i in range(1, buckets)]
    bounds = reps.agg(F.percentile_approx("length", F.array(*map(F.lit, shares)), 10_000)).head()[0] if shares else []
    bucket = sum((F.when(F.col("length") < b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    placed = reps.withColumn("bucket", bucket)
    # Vectors of one length can't be told apart by it: large buckets are split.
    sizes = placed.groupBy("bucket").count().select(
        F.col("bucket").alias("b"), F.ceil(F.col("count") / (2 * CANDIDATES)).cast("int").alias("splits")
    )
    split = F.pmod(F.xxhash64("rep"), F.col("splits")).cast("int")
    # One row for each bucket.
    placed = placed.join(F.broadcast(sizes), F.col("bucket") == F.col("b")).withColumn("split", split)
    most = sizes.agg(F.max("splits")).head()[0] or 1
    placed = placed.withColumn("block", F.col("bucket") * most + F.col("split")).drop("b", "splits", "split")
    placed, _ = write_scratch(placed, "buckets")

    def one(asked_table, given_table):
        lengths = given_table.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        ids, lengths = given_table.column("rep").to_numpy()[order], lengths[order]
        vectors = matrix(given_table.column("v"), np.int64)[order]
        q_ids, q_vectors = asked_table.column("qrep").to_numpy(), matrix(asked_table.column("v"), np.int64)
        known = asked_table.column("bound").to_pylist()
        out = ([], [], [])
        for q, q_id, bound in zip(q_vectors, q_ids, known):
            q_length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
            place = left_over(q, q_length, bound, vectors, lengths)
            if not len(place):
                continue
            scores = products(vectors[place], q)
            top = best(scores, ids[place], k + 1)
            if bound is not None:
                top = top[scores[top] >= bound]
            out[0].append(np.full(len(top), q_id))
            out[1].append(ids[place][top])
            out[2].append(scores[top])
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        return pa.table({n: join(c) for n, c in zip(("qrep", "rep", "score"), out)})

    fields = "qrep long, rep long, score long"
    unbound = qreps.withColumn("bound", F.lit(None).cast("long"))
    longest = placed.filter(F.col("bucket") == 0)
    first, _ = write_scratch(meet(longest, unbound, n_queries, range(most), one, fields), "first")
    order = Window.partitionBy("qrep").orderBy(F.desc("score"), "rep")
    kth = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k + 1)
    bound = qreps.join(kth.select("qrep", F.col("score").alias("bound")), "qrep", "left")
    if buckets > 1:
        others = placed.filter(F.col("bucket") > 0)
        rest = meet(others, bound, n_queries, range(most, buckets * most), one, fields)
        first = first.unionByName(rest)
    return answers(first, classes, asked, k)
