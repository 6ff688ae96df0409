"""Recursive multi-day forecasts over state rows.

A state row holds, per input column, the values of the last days before a cutoff as an
array (oldest first, NULL = no row that day). A step reads date-based features from the
array ends, predicts, and appends: the target array by the clipped prediction, every
other array by NULL, because a forecast day has no other readings. Nothing is shuffled.
"""

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DATE, TARGET
from nimbora.functions.arrays import array_mean, array_std, array_sum, let
from nimbora.functions.calendar import CALENDAR
from nimbora.functions.scoring import non_negative
from nimbora.operators.specs import LAG, FeatureConfig, Spec
from nimbora.operators.trees import MODEL_FIELDS, tree_sum


def _missing() -> Column:
    return F.lit(None).cast("double")


# Statistic of a non-empty array, and how many values it needs.
STATISTICS = {
    "mean": (array_mean, 1),
    "std": (array_std, 2),
    "max": (F.array_max, 1),
    "min": (F.array_min, 1),
    "sum": (array_sum, 1),
}


def state_feature(spec: Spec, arrays: dict[str, Column]) -> Column:
    """Date-based feature of the day after the arrays' last day.

    A day has a row exactly when its target value is there: the target is never missing
    in a clean series, and forecast days carry their prediction.
    """
    target, values = arrays[TARGET], arrays[spec.column]
    if spec.kind == LAG:
        present = F.element_at(target, -spec.window).isNotNull()
        return F.when(present, F.element_at(values, -spec.window)).otherwise(F.lit(0.0))
    statistic, needed = STATISTICS[spec.kind]

    def of_frame(seen: Column) -> Column:
        return F.when(F.size(seen) >= needed, statistic(seen))

    derived = let(F.array_compact(F.slice(values, -spec.window, spec.window)), of_frame)
    if spec.column == TARGET or spec.kind == "sum":
        return F.coalesce(derived, F.lit(0.0))
    days = F.size(F.array_compact(F.slice(target, -spec.window, spec.window)))
    return F.when(days < needed, F.lit(0.0)).otherwise(derived)


def step_inputs(config: FeatureConfig, arrays: dict[str, Column], date: Column) -> list[Column]:
    """Model inputs of one forecast day in `config.columns` order.

    A statistic of days that have rows but no readings is undefined; learners that take
    no missing values get 0, the value every other unavailable feature has.
    """
    derived = [F.coalesce(state_feature(s, arrays), F.lit(0.0)) for s in config.specs]
    return [*derived, *[CALENDAR[c](date).cast("double") for c in config.calendar]]


def recursive_path(
    config: FeatureConfig,
    arrays: dict[str, Column],
    cutoff: Column,
    predict: Callable[[list[Column]], Column],
) -> Column:
    """Array of `config.horizon` clipped predictions, all steps inside one expression."""
    config.check_recursion()
    start = F.struct(*[a.alias(c) for c, a in arrays.items()])

    def advance(state: Column, step: Column) -> Column:
        held = {c: state[c] for c in arrays}
        inputs = step_inputs(config, held, F.date_add(cutoff, step))
        predicted = non_negative(predict(inputs))
        return F.struct(
            *[
                F.concat(a, F.array(predicted if c == TARGET else _missing())).alias(c)
                for c, a in held.items()
            ]
        )

    steps = F.sequence(F.lit(1), F.lit(config.horizon))
    return F.aggregate(
        steps,
        start,
        advance,
        lambda state: F.slice(state[TARGET], -config.horizon, config.horizon),
    )


def linear_path(
    config: FeatureConfig,
    arrays: dict[str, Column],
    cutoff: Column,
    intercept: Column,
    coefficients: Column,
    exponentiate: bool = False,
) -> Column:
    """`recursive_path` of a linear model given as columns; `exponentiate` for a log link."""

    def predict(inputs: list[Column]) -> Column:
        total = intercept
        for i, value in enumerate(inputs):
            total = total + coefficients[i] * value
        return F.exp(total) if exponentiate else total

    return recursive_path(config, arrays, cutoff, predict)


def tree_path(
    config: FeatureConfig,
    arrays: dict[str, Column],
    cutoff: Column,
    model: dict[str, Column],
    depth: int,
    exponentiate: bool = False,
) -> Column:
    """`recursive_path` of a tree ensemble given as columns; `exponentiate` for a log link."""

    def predict(inputs: list[Column]) -> Column:
        total = tree_sum(inputs, *(model[f] for f in MODEL_FIELDS), depth)
        return F.exp(total) if exponentiate else total

    return recursive_path(config, arrays, cutoff, predict)


def transform_path(
    state: DataFrame, config: FeatureConfig, inputs: Sequence[str], model
) -> DataFrame:
    """Add `path`, the clipped predictions of an MLlib regression model.

    `state` has `cutoff` and one array column per input. Every step is a projection and
    one `model.transform`; all stations advance together.
    """
    config.check_recursion()
    carried = [c for c in state.columns if c not in inputs]
    assembler = VectorAssembler(inputCols=config.columns, outputCol="features")
    rows = state
    for step in range(1, config.horizon + 1):
        arrays = {c: F.col(c) for c in inputs}
        values = step_inputs(config, arrays, F.date_add("cutoff", step))
        ready = rows.select("*", *[v.alias(n) for v, n in zip(values, config.columns)])
        scored = model.transform(assembler.transform(ready))
        added = {c: _missing() for c in inputs} | {TARGET: non_negative(F.col("prediction"))}
        rows = scored.select(
            *carried, *[F.concat(c, F.array(added[c])).alias(c) for c in inputs]
        )
    path = F.slice(TARGET, -config.horizon, config.horizon).alias("path")
    return rows.select(*carried, path)


def as_predictions(paths: DataFrame, path: str = "path", observed: str | None = "observed") -> DataFrame:
    """Explode forecast arrays to rows, pairing step n with the n-th observed value.

    Needs `cutoff`; other columns but the two arrays are kept.
    """
    kept = [F.col(c) for c in paths.columns if c not in (path, observed)]
    if observed:
        actual = F.try_element_at(F.col(observed), F.col("pos") + 1)
        spread = paths.select(*kept, observed, F.posexplode(path).alias("pos", "prediction"))
    else:
        actual = _missing()
        spread = paths.select(*kept, F.posexplode(path).alias("pos", "prediction"))
    step = F.col("pos") + 1
    return spread.select(
        *kept,
        step.alias("step"),
        F.date_add("cutoff", step).alias(DATE),
        "prediction",
        actual.alias("actual"),
    )
