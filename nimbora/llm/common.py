"""Small helpers shared by the operators of this package."""

import sys
import types

from pyspark.sql import DataFrame, SparkSession

from nimbora.session import scratch_path

# Python sees at most this many rows of text at a time, so that a run of very long
# documents does not fill a worker; Spark's own byte limit on batches holds besides.
TEXT_ROWS = 512


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove scratch folders that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks, or until another owner asks for
    one: the steps of a job come after each other and need not hold what they remember side by side."""
    name = "nimbora_worker_cache"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if held.get("owner") != owner:
        held["owner"], held["cache"] = owner, {}
    return held["cache"]


def slices(batches, rows: int = TEXT_ROWS):
    """Arrow batches cut to at most `rows` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
