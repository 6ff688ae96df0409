"""Feature specs: small frozen values that name a column and how it is derived."""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from nimbora.constants import BASE_COLUMNS, HORIZON, TARGET
from nimbora.functions.calendar import CALENDAR

# The six kinds and how each names its column.
LAG = "lag"
STATS = ("mean", "std", "max", "min", "sum")
KINDS = (LAG, *STATS)


@dataclass(frozen=True)
class Spec:
    """`kind` over the last `window` days or rows of `column`."""

    column: str
    kind: str
    window: int

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind: {self.kind}")
        if self.column not in BASE_COLUMNS:
            raise ValueError(f"unknown base column: {self.column}")
        if self.window < 1:
            raise ValueError("a feature window is at least one day")

    @property
    def name(self) -> str:
        if self.kind == LAG:
            return f"{self.column}_lag_{self.window}d"
        return f"{self.column}_rolling_{self.window}d_{self.kind}"


@dataclass(frozen=True)
class FeatureConfig:
    """One candidate feature set: specs, calendar columns and forecast horizon."""

    config_id: str
    specs: tuple[Spec, ...]
    calendar: tuple[str, ...] = ("day_of_year",)
    horizon: int = HORIZON

    def __post_init__(self) -> None:
        unknown = set(self.calendar) - set(CALENDAR)
        if unknown:
            raise ValueError(f"unknown calendar columns: {sorted(unknown)}")
        if self.horizon < 1:
            raise ValueError("a forecast horizon is at least one day")

    @property
    def warmup(self) -> int:
        return max_window(self.specs)

    @property
    def columns(self) -> list[str]:
        """Model inputs, in order."""
        return [*(s.name for s in self.specs), *self.calendar]

    @property
    def inputs(self) -> list[str]:
        """Base columns the features read, target first."""
        return base_columns(self.specs)

    def check_recursion(self) -> None:
        """A lag shorter than the horizon would read days the forecast does not know."""
        for spec in self.specs:
            if spec.kind == LAG and spec.column != TARGET and spec.window < self.horizon:
                raise ValueError(
                    f"{spec.name} looks back less than the {self.horizon}-day horizon"
                )


def max_window(specs: Iterable[Spec]) -> int:
    return max((s.window for s in specs), default=0)


def base_columns(specs: Iterable[Spec]) -> list[str]:
    return list(dict.fromkeys([TARGET, *(s.column for s in specs)]))


def distinct_specs(configs: Sequence[FeatureConfig]) -> tuple[Spec, ...]:
    """Union of all specs, so the features of many configs are computed once."""
    return tuple(dict.fromkeys(s for c in configs for s in c.specs))


# The default feature set.
DEFAULT_SPECS = (
    *(Spec(TARGET, LAG, n) for n in (14, 16, 18, 20)),
    Spec("average_humidity", LAG, 14),
    *(Spec(TARGET, "std", n) for n in (14, 25)),
)
DEFAULT_CONFIG = FeatureConfig("default", DEFAULT_SPECS)
LOOKBACK_DAYS = 2 * DEFAULT_CONFIG.warmup + 1
