"""JSON shards: array files found below a folder, and one-object-per-line files."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.sources.records import from_fields

# A file counts as later than another when its path, compared folder by folder, is.
ARRIVAL_TYPE = "struct<parts:array<string>,start:bigint,pos:bigint>"


def discover_shards(
    spark: SparkSession, folder: str | list[str], pattern: str = "*.json"
) -> DataFrame:
    """One row per file below `folder`: (path, value), value being the whole text."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def shard_paths(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Paths only, in import order; the text of the files is not read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return listing.select("path").orderBy(F.split("path", "/"))


def _arrival(start: Column, pos: Column) -> Column:
    return F.struct(
        F.split("path", "/").alias("parts"),
        start.cast("bigint").alias("start"),
        pos.cast("bigint").alias("pos"),
    ).alias("arrival")


def _parsed(files: DataFrame) -> DataFrame:
    """(path, value, items): the array's elements, NULL where the text is no JSON array.

    Each element is a variant of its own, so only an element, never the file, has the size limit
    of a variant; the text itself is one value, at most 2 GB. Of a repeated key the last counts.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return files.select("path", "value", F.from_json("value", "array<variant>").alias("items"))


def _objects(arrays: DataFrame) -> DataFrame:
    """Explode (path, items) to records; elements that are no objects are skipped."""
    elements = arrays.select("path", F.posexplode("items").alias("pos", "item"))
    objects = elements.filter(F.schema_of_variant("item").startswith("OBJECT"))
    return from_fields(
        objects.select(
            "path",
            _arrival(F.lit(0), F.col("pos")),
            F.col("item").cast("map<string,string>").alias("fields"),
        )
    )


def read_shards(spark: SparkSession, folder: str | list[str], pattern: str = "*.json") -> DataFrame:
    """Records of all array files below `folder`, with `path` and `arrival`.

    A file that is no JSON array stops the job.
    """
    parsed = _parsed(discover_shards(spark, folder, pattern))
    complaint = F.concat(F.lit("Expected a JSON array in "), F.col("path"))
    checked = F.coalesce("items", F.raise_error(complaint).cast("array<variant>"))
    return _objects(parsed.select("path", checked.alias("items")))


@dataclass(frozen=True)
class TolerantLoad:
    records: DataFrame
    rejected: DataFrame  # (path, error)


def read_shards_tolerant(
    spark: SparkSession, folder: str | list[str], pattern: str = "*.json"
) -> TolerantLoad:
    """Like `read_shards`, but bad files end up in `rejected` and the rest still loads."""
    parsed = _parsed(discover_shards(spark, folder, pattern))
    good = parsed.filter(F.col("items").isNotNull())
    opens_array = F.ltrim("value").startswith("[")
    other_json = ~opens_array & F.try_parse_json("value").isNotNull()
    error = F.when(other_json, F.lit("not a JSON array")).otherwise(F.lit("not valid JSON"))
    bad = parsed.filter(F.col("items").isNull()).select("path", error.alias("error"))
    return TolerantLoad(_objects(good), bad)


def line_records(lines: DataFrame) -> DataFrame:
    """(path, start, value) text lines to records; a line that is no object is skipped.

    Unlike an array file, a line file is splittable, so its size sets the number of
    tasks. `start` is the offset of the split a line came from.
    """
    numbered = lines.withColumn("pos", F.monotonically_increasing_id())
    parsed = numbered.filter(F.trim("value") != "").select(
        "path", "start", "pos", F.parse_json("value").alias("parsed")
    )
    objects = parsed.filter(F.schema_of_variant("parsed").startswith("OBJECT"))
    return from_fields(
        objects.select(
            "path",
            _arrival(F.col("start"), F.col("pos")),
            F.col("parsed").cast("map<string,string>").alias("fields"),
        )
    )


def read_lines(spark: SparkSession, folder: str | list[str], pattern: str = "*") -> DataFrame:
    """Records of all one-object-per-line files below `folder`."""
    return line_records(
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            "value",
        )
    )
