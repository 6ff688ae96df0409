"""What both vector searches share: usable vectors, classes of equal vectors, query and candidate
blocks, and the merge of block results.

Equal vectors score the same, so a class of them is searched once and its k + 1 smallest ids are
enough for any top k. A third of all rows may be one vector without weighing more than k + 1 rows.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import write_scratch

#: Rows of a candidate block and of a query block, about.
CANDIDATES, QUERIES = 4096, 2048


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components, of the most common length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    valid = valid.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = valid.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").head(1)
    return valid.filter(F.size("v") == (sizes[0]["s"] if sizes else 0))


def members(rows: DataFrame, count: int) -> DataFrame:
    """(id, v, rep): the `count` smallest ids of each class of equal vectors; rep is the smallest."""
    # With the place alone in the window, each task limits its own rows of a class before the shuffle.
    order = Window.partitionBy("v").orderBy("id")
    placed = rows.dropDuplicates(["id", "v"]).withColumn("place", F.row_number().over(order))
    classes = rows.groupBy("v").agg(F.min("id").alias("rep"))
    return placed.filter(F.col("place") <= count).join(classes, "v").select("id", "v", "rep")


def query_classes(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrep, v) to search, and (query_id, qrep) to answer."""
    classes = queries.groupBy("v").agg(F.min("id").alias("qrep"))
    asked = queries.dropDuplicates(["id", "v"]).join(classes, "v").select(F.col("id").alias("query_id"), "qrep")
    return classes, asked


def block_of(column: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def blocks_for(count: int, size: int) -> int:
    return max(1, -(-count // size))


def meet(candidates: DataFrame, queries: DataFrame, n_queries: int, blocks: range, search, fields: str) -> DataFrame:
    """`search(query table, candidate table)` for every query block and candidate block.

    Blocks are bounded by their size parameters, so no task holds more than two of them; a stated
    query set meets all rows block by block. Candidates have their `block`, out of `blocks`.
    """
    import pyarrow as pa

    q_blocks = blocks_for(n_queries, QUERIES)
    right = candidates.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    left = queries.withColumn("qblock", block_of("qrep", q_blocks))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(blocks.start), F.lit(blocks.stop - 1))))
    empty = pa.schema([("qrep", pa.int64()), ("rep", pa.int64()), ("score", pa.int64() if "score long" in fields else pa.float64())])

    def run(key, asked, given):
        if not asked.num_rows or not given.num_rows:
            return empty.empty_table()
        return search(asked, given)

    return left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(run, fields)


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Arrow lists of one length as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, ties to smaller ids."""
    if len(scores) > 4 * count:
        floor = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:count]]
    return np.lexsort((ids, -scores))[:count]


def answers(found: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from (qrep, rep, score) of the best classes of each block."""
    order = Window.partitionBy("qrep").orderBy(F.desc("score"), "rep")
    top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")
    ids = classes.select(F.col("id").alias("vec_id"), "rep")
    order = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    rows = top.join(ids, "rep").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    rows, _ = write_scratch(rows.select("qrep", "vec_id", "score"), "top")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = asked.join(rows, "qrep").filter(F.col("vec_id") != F.col("query_id"))
    ranked = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
