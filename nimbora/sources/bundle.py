"""Model bundles: an MLlib model folder next to a validated manifest.

A third part, `inputs`, holds what the manifest has no field for: how each input is derived and how
much it varied in training. Bundles without it load as well.
"""

import json
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.ml.regression import GBTRegressionModel, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.learners import FittedModel
from nimbora.operators.specs import FeatureConfig, Spec

# Manifest version and field names.
MANIFEST_VERSION = 1
MANIFEST_FIELDS = (
    "version",
    "model_name",
    "seed",
    "min_date",
    "max_date",
    "forecast_horizon",
    "feature_columns",
    "additional_date_features",
)

_MODELS = {"BoostedTrees": GBTRegressionModel, "TweedieGlm": GeneralizedLinearRegressionModel}


@dataclass(frozen=True)
class Manifest:
    """What a saved model was trained on and for."""

    model_name: str
    seed: int
    min_date: date
    max_date: date
    forecast_horizon: int
    feature_columns: list[str]
    additional_date_features: list[str]
    version: int = MANIFEST_VERSION

    def to_json(self) -> str:
        values = asdict(self)
        return json.dumps({name: values[name] for name in MANIFEST_FIELDS}, default=str)


def check_manifests(manifests: DataFrame, text: str = "text") -> DataFrame:
    """Validate a table of manifest JSON: adds `error` (NULL = valid) and the parsed fields.

    Rules are tried in a fixed order and the first one broken is reported.
    """
    parsed = manifests.withColumn("_v", F.try_parse_json(text))

    def kind(field: str) -> Column:
        return F.coalesce(F.schema_of_variant(_at(field, "variant")), F.lit("absent"))

    def _at(field: str, as_type: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{field}", as_type)

    def texts(field: str) -> Column:
        elements = _at(field, "array<variant>")
        all_texts = F.forall(elements, lambda e: F.schema_of_variant(e) == "STRING")
        return kind(field).startswith("ARRAY") & F.coalesce(all_texts, F.lit(False))

    def bad_day(field: str) -> Column:
        return F.try_to_date(_at(field, "string"), "yyyy-MM-dd").isNull()

    both_texts = (kind("min_date") == "STRING") & (kind("max_date") == "STRING")
    rules = [
        (F.col("_v").isNull(), F.lit("manifest is not valid JSON")),
        (
            ~F.schema_of_variant("_v").startswith("OBJECT"),
            F.lit("manifest root must be a JSON object"),
        ),
        (kind("version") != "BIGINT", F.lit("manifest.version must be an int")),
        (
            _at("version", "bigint") != MANIFEST_VERSION,
            F.concat(F.lit("Unsupported manifest version: "), _at("version", "string")),
        ),
        (kind("model_name") != "STRING", F.lit("manifest.model_name must be a str")),
        (kind("seed") != "BIGINT", F.lit("manifest.seed must be an int")),
        (~both_texts, F.lit("manifest min_date and max_date must be ISO date strings")),
        (kind("forecast_horizon") != "BIGINT", F.lit("manifest.forecast_horizon must be an int")),
        (~texts("feature_columns"), F.lit("manifest.feature_columns must be a list of str")),
        (
            ~texts("additional_date_features"),
            F.lit("manifest.additional_date_features must be a list of str"),
        ),
        *[
            (bad_day(f), F.concat(F.lit("Invalid isoformat string: "), _at(f, "string")))
            for f in ("min_date", "max_date")
        ],
    ]
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    types = {
        "version": "int",
        "model_name": "string",
        "seed": "bigint",
        "min_date": "string",
        "max_date": "string",
        "forecast_horizon": "int",
        "feature_columns": "array<string>",
        "additional_date_features": "array<string>",
    }
    checked = parsed.withColumn("error", error)
    fields = [F.when(F.col("error").isNull(), _at(f, t)).alias(f) for f, t in types.items()]
    return checked.select(*manifests.columns, "error", *fields)


def parse_manifest(spark: SparkSession, text: str) -> Manifest:
    """One manifest text; raises ValueError with the broken rule."""
    (row,) = check_manifests(spark.createDataFrame([(text,)], "text string")).collect()
    if row.error is not None:
        raise ValueError(row.error)
    values = {name: row[name] for name in MANIFEST_FIELDS}
    for name in ("min_date", "max_date"):
        values[name] = date.fromisoformat(values[name])
    return Manifest(**values)


def save_bundle(
    spark: SparkSession, fitted: FittedModel, manifest: Manifest, path: str, config: FeatureConfig | None = None
) -> None:
    """Write the model, its manifest and its inputs below `path`, replacing what is there."""
    if manifest.model_name not in _MODELS:
        raise ValueError(f"unknown model: {manifest.model_name}")
    fitted.model.write().overwrite().save(f"{path}/model")
    specs = [[s.column, s.kind, s.window] for s in config.specs] if config else None
    inputs = json.dumps({"config_id": config and config.config_id, "specs": specs, "extra": fitted.extra})
    for part, value in (("manifest", manifest.to_json()), ("inputs", inputs)):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")


def load_bundle(spark: SparkSession, path: str) -> tuple[FittedModel, Manifest]:
    """Read a bundle back; a missing part or an invalid manifest raises."""
    for part in ("model", "manifest"):
        if not _exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"Missing {part}: {path}/{part}")
    (row,) = spark.read.text(f"{path}/manifest").collect()
    manifest = parse_manifest(spark, row.value)
    if manifest.model_name not in _MODELS:
        raise ValueError(f"unknown model: {manifest.model_name}")
    model = _MODELS[manifest.model_name].load(f"{path}/model")
    extra = _inputs(spark, path).get("extra") or {}
    return FittedModel(manifest.model_name, model, manifest.feature_columns, extra), manifest


def load_config(spark: SparkSession, path: str, manifest: Manifest) -> FeatureConfig:
    """The feature set a bundle was fitted with; ValueError if its columns are not the manifest's."""
    inputs = _inputs(spark, path)
    if inputs.get("specs") is None:
        raise FileNotFoundError(f"Missing inputs: {path}/inputs")
    config = FeatureConfig(
        inputs["config_id"],
        tuple(Spec(*s) for s in inputs["specs"]),
        tuple(manifest.additional_date_features),
        manifest.forecast_horizon,
    )
    if config.columns != manifest.feature_columns:
        raise ValueError("the bundle's inputs are not the manifest's feature columns")
    return config


def _inputs(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, f"{path}/inputs"):
        return {}
    (row,) = spark.read.text(f"{path}/inputs").collect()
    return json.loads(row.value)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
