"""Where results go: raw records as JSON lines, result tables as Parquet."""

from pyspark.sql import DataFrame

from nimbora.sources.records import to_json_text


def write_json_lines(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as one JSON object per line, readable again by `read_lines`."""
    records.select(to_json_text(records).alias("value")).write.mode(mode).text(path)


def write_table(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result table: metrics, leaderboard, residual spread or importances."""
    result.write.mode(mode).parquet(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics records as JSON lines."""
    metrics.write.mode(mode).json(path)
