"""DuckDB side: the SQL text each registered query must agree with.

Texts are put together from common table expressions. The record expressions are those
of the table adapter; everything after that is written out independently. Values are shifted by
1.37e-8 before rounding, as on the Spark side, so that no exact half has to be rounded.
"""

from catalog.queries import FIXED_WEIGHTS
from nimbora.constants import METRIC_FIELDS, NUMBER_FIELDS, STEP_SPREAD_MM
from nimbora.sources.adapter import DERIVED, FIELDS

_ORDERS = """
amounts as (
  select o_orderkey arrival, concat('R', cast(n_regionkey as string)) idema,
         cast(cast(o_orderdate as date) as string) fecha,
         cast(round(o_totalprice * 100) as bigint) c
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

_LINES = """
amounts as (
  select (l_orderkey, l_linenumber, l_partkey, l_extendedprice) arrival,
         concat('S', cast(l_suppkey as string)) idema,
         cast(cast(l_shipdate as date) as string) fecha,
         cast(round(l_extendedprice * 100) as bigint) c
  from lineitem)"""

_STEPS = ", ".join(f"{e} {n}" for n, e in DERIVED.items())
_READINGS = ", ".join(f"{e} {f}" for f, e in FIELDS.items())
_RAW = f"""
steps as (select *, {_STEPS} from amounts),
raw as (select arrival, idema, fecha, {_READINGS} from steps),
latest as (
  select * exclude (rn) from (
    select *, row_number() over (partition by idema, fecha order by arrival desc) rn from raw)
  where rn = 1)"""


def _number(field: str) -> str:
    codes = "when 'Ip' then 0.05e0 when 'Acum' then 0e0" if field == "prec" else ""
    return (
        f"case {field} {codes} when '' then 0e0 when '0' then 0e0 "
        f"else cast(replace(replace({field}, '.', ''), ',', '.') as double) end"
    )


_SECTOR = """case when dir is null or cast(dir as int) in (88, 99) then null
  when cast(dir as int) * 10 >= 0 and cast(dir as int) * 10 < 360
  then floor(cast(dir as int) * 10 / 45) else 0 end"""

_PARSED = (
    "parsed as (select idema, cast(fecha as date) date, "
    + ", ".join(f"{_number(f)} {c}" for f, c in NUMBER_FIELDS.items())
    + f", cast({_SECTOR} as double) wind_direction from latest)"
)
_CLEAN = (
    "clean as (select idema, date, "
    + ", ".join(
        f"coalesce({c}, avg({c}) over (partition by idema), 0e0) {c}"
        for c in NUMBER_FIELDS.values()
    )
    + ", cast(trunc(coalesce(wind_direction, avg(wind_direction) over (partition by idema), 0))"
    " as int) wind_direction,"
    " row_number() over (partition by idema order by date) rn from parsed)"
)

_KEYS = f"idema, fecha, {', '.join(METRIC_FIELDS)}"


def _with(*ctes: str, base: str = _ORDERS) -> str:
    return "with recursive" + ",\n".join([base, _RAW, *ctes])


def _clean(*ctes: str, base: str = _ORDERS) -> str:
    return _with(_PARSED, _CLEAN, *ctes, base=base)


# --- features ---------------------------------------------------------------

_FUNCTIONS = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min", "sum": "sum"}
_W = "partition by idema order by date"


def _bulk_lag(column: str, n: int) -> str:
    return f"coalesce(lag({column}, {n}) over ({_W}), 0e0)"


def _bulk_roll(column: str, n: int, kind: str, end: str = "current row") -> str:
    frame = f"rows between {n - 1} preceding and {end}"
    if end != "current row":
        frame = f"rows between {n} preceding and 1 preceding"
    return f"coalesce({_FUNCTIONS[kind]}({column}) over ({_W} {frame}), 0e0)"


def _six(expression: str, name: str) -> str:
    return f"round({expression} + 1.37e-8, 6) {name}"


_DEFAULT_BULK = {
    **{f"precipitation_lag_{n}d": _bulk_lag("precipitation", n) for n in (14, 16, 18, 20)},
    "average_humidity_lag_14d": _bulk_lag("average_humidity", 14),
    **{f"precipitation_rolling_{n}d_std": _bulk_roll("precipitation", n, "std") for n in (14, 25)},
}


def _features(base: str) -> str:
    columns = ", ".join(f"{e} {n}" for n, e in _DEFAULT_BULK.items())
    shown = ", ".join(_six(n, n) for n in ("precipitation", "average_humidity", *_DEFAULT_BULK))
    features = f"""features as (
  select *, {columns}, cast(dayofyear(date) as int) day_of_year from clean)"""
    return (
        _clean(features, base=base)
        + f"\nselect idema, date, {shown}, day_of_year from features where rn > 25"
    )


def _seasonality(base: str) -> str:
    week = f"""week as (select idema, cast(dayofyear(date) as int) day_of_year,
  sum(precipitation) over ({_W} rows between 6 preceding and current row) s from clean)"""
    return (
        _clean(week, base=base)
        + "\nselect idema, day_of_year, round(avg(s) + 1.37e-8, 6) week_sum from week group by all"
    )


# --- date-based features: range self-joins ----------------------------------


def _asof_value(column: str, kind: str, n: int) -> str:
    """Aggregate over history rows h of target t, to be grouped by target."""
    if kind == "lag":
        return f"coalesce(max(h.{column}) filter (where h.date = t.date - {n}), 0e0)"
    inside = f"filter (where h.date >= t.date - {n} and h.date < t.date)"
    return f"coalesce({_FUNCTIONS[kind]}(h.{column}) {inside}, 0e0)"


def _asof_name(column: str, kind: str, n: int) -> str:
    return f"{column}_lag_{n}d" if kind == "lag" else f"{column}_rolling_{n}d_{kind}"


_ASOF_DEFAULT = [
    *[("precipitation", "lag", n) for n in (14, 16, 18, 20)],
    ("average_humidity", "lag", 14),
    *[("precipitation", "std", n) for n in (14, 25)],
]


def _asof(specs, base: str = _ORDERS, targets: str = "clean", extra: str = "", ctes=()) -> str:
    reach = max(n for _, _, n in specs)
    shown = ", ".join(_six(_asof_value(*s), _asof_name(*s)) for s in specs)
    return (
        _clean(*ctes, base=base)
        + f"""
select t.idema, t.date, {shown}{extra}
from {targets} t left join clean h
  on h.idema = t.idema and h.date >= t.date - {reach} and h.date < t.date
group by t.idema, t.date"""
    )


# --- folds ------------------------------------------------------------------

_GRID = """
years as (select distinct cast(year(date) as int) y from clean),
grid as (
  select cast(y * 1000 + s as int) fold_id, y as year, cast(s as int) start_day,
         cast(make_date(y - 1, 12, 31) + cast(s as int) as date) cutoff
  from (select y, unnest(range(0, dayofyear(make_date(y, 12, 31)) + 1, 14)) s from years)),
tests as (
  select c.idema, g.fold_id, g.year, g.cutoff, c.date, c.precipitation actual,
         row_number() over (partition by c.idema, g.fold_id order by c.date) step
  from grid g join clean c on c.date > g.cutoff and c.date <= g.cutoff + 14)"""


def _standin(lag: int) -> str:
    """Naive predictions `date - lag`, one row per station, fold and step."""
    return f"""
standin_{lag} as (
  select 'lag_{lag}' config_id, f.idema, f.fold_id, f.year, f.cutoff, f.step,
         cast(f.cutoff + cast(f.step as int) as date) date, coalesce(p.precipitation, 0e0) prediction
  from (select *, unnest(range(1, 15)) step
        from (select distinct idema, fold_id, year, cutoff from tests)) f
  left join clean p
    on p.idema = f.idema and p.date = f.cutoff + cast(f.step as int) - {lag}),
pairs_{lag} as (
  select s.*, t.actual from standin_{lag} s join tests t
    on t.idema = s.idema and t.fold_id = s.fold_id and t.step = s.step)"""


_MAE = "avg(abs(actual - prediction))"
_RAIN = """avg(abs(actual - prediction)
    * case when actual >= 4 and prediction >= 4 then 0.5e0 else 1e0 end
    * (1e0 + case when actual >= 2 and prediction < 2 then 4e0 else 0e0 end
           + case when actual <= 2 and prediction > 2 then 3e0 else 0e0 end))
  * (1e0 + avg(case when (actual >= 2 and prediction < 2) or (actual <= 2 and prediction > 2)
                    then 1e0 else 0e0 end))"""


def _scores(pairs: str) -> str:
    return f"""scores as (
  select config_id, idema, year, fold_id, cutoff, cast(count(*) as int) n,
         {_MAE} mae, {_RAIN} rain_error
  from {pairs} group by all)"""


_SUMMARY = """
yearly as (select config_id, idema, year, avg(mae) mae from scores group by all),
summary as (
  select y.config_id, y.idema, y.mae, y.mae_std, r.rain_error
  from (select config_id, idema, avg(mae) mae, stddev_pop(mae) mae_std
        from yearly group by all) y
  join (select config_id, idema, avg(rain_error) rain_error from scores group by all) r
    on r.config_id = y.config_id and r.idema = y.idema)"""

_LEVEL = (
    "cast(case when {0} < 2 then 0 when {0} <= 5 then 1 when {0} <= 10 then 2 "
    "when {0} < 50 then 3 else 4 end as int)"
)

_SPREAD = "spread as (select * from (values {}) v(step, sd))".format(
    ", ".join(f"({i}, {sd!r}e0)" for i, sd in enumerate(STEP_SPREAD_MM, start=1))
)

_YEAR_ENDS = """
ends as (select idema, max(date) cutoff from clean group by idema, year(date))"""

_CONTEXT = """
context as (select c.idema, e.cutoff, c.date, c.precipitation
  from clean c join ends e on e.idema = c.idema
   and c.date >= e.cutoff - 30 and c.date <= e.cutoff and c.date < e.cutoff + 14)"""

# --- fixed recursive forecast -----------------------------------------------

_B0, _LAG, _MEAN, _STD, _DOY = FIXED_WEIGHTS

# `vals` holds one entry per day, oldest first, NULL where a day has no row.
_RECURSION = f"""
states as (
  select g.fold_id, g.cutoff, c.idema,
         list_transform(range(13, -1, -1), lambda k: map_from_entries(list(
           (datediff('day', c.date, g.cutoff), c.precipitation)))[k]) vals
  from grid g join clean c on c.date > g.cutoff - 14 and c.date <= g.cutoff
  group by all),
known as (
  select g.fold_id, g.cutoff, c.idema
  from grid g join clean c on c.date > g.cutoff - 14 and c.date <= g.cutoff + 14
  group by all),
starts as (
  select k.*, coalesce(s.vals, list_transform(range(14), lambda k: cast(null as double))) vals
  from known k left join states s on s.fold_id = k.fold_id and s.idema = k.idema),
walk as (
  select fold_id, cutoff, idema, 0 step, vals, cast(null as double) prediction from starts
  union all
  select fold_id, cutoff, idema, step + 1, list_append(vals, p), p
  from (
    select fold_id, cutoff, idema, step, vals,
      greatest({_B0!r}e0
        + {_LAG!r}e0 * coalesce(vals[-14], 0e0)
        + {_MEAN!r}e0 * coalesce(list_avg(vals[-3:]), 0e0)
        + ({_STD!r}e0) * coalesce(list_stddev_samp(vals[-5:]), 0e0)
        + {_DOY!r}e0 * dayofyear(cutoff + step + 1), 0e0) p
    from walk where step < 14))"""

# --- least squares with two inputs in closed form ---------------------------

_SMALL = f"""
rows_ as (select *, {_bulk_lag("precipitation", 14)} x, cast(dayofyear(date) as double) d
  from clean qualify rn > 14),
small_grid as (%s),
moments as (
  select r.idema, g.fold_id, g.year, g.cutoff,
         avg(x) mx, avg(d) md, avg(precipitation) my,
         var_pop(x) vx, var_pop(d) vd, covar_pop(x, d) cxd,
         covar_pop(x, precipitation) cxy, covar_pop(d, precipitation) cdy
  from small_grid g join rows_ r on r.date <= g.cutoff group by all),
fits as (
  select *,
    case when flat_x then 0e0 when flat_d then cxy / vx when same then cxy / vx / 2
         else (cxy * vd - cdy * cxd) / (vx * vd - cxd * cxd) end bx,
    case when flat_d then 0e0 when flat_x then cdy / vd when same then cdy / vd / 2
         else (cdy * vx - cxy * cxd) / (vx * vd - cxd * cxd) end bd
  from (select *, 1 - abs(cxd) / sqrt(vx * vd) <= 1e-10 same from
    (select *, vx <= 1e-12 * greatest(1, mx * mx) flat_x, vd <= 1e-12 * greatest(1, md * md) flat_d
     from moments))),
small_tests as (
  select r.idema, g.fold_id, r.precipitation actual,
         row_number() over (partition by r.idema, g.fold_id order by r.date) step
  from small_grid g join rows_ r on r.date > g.cutoff and r.date <= g.cutoff + 14),
small_pred as (
  select 'small' config_id, f.idema, f.fold_id, f.year, f.cutoff, cast(f.step as int) step,
         cast(f.cutoff + cast(f.step as int) as date) date,
         greatest(f.my + f.bx * (coalesce(p.precipitation, 0e0) - f.mx)
           + f.bd * (dayofyear(f.cutoff + cast(f.step as int)) - f.md), 0e0) prediction,
         t.actual
  from (select *, unnest(range(1, 15)) step from fits) f
  left join rows_ p on p.idema = f.idema and p.date = f.cutoff + cast(f.step as int) - 14
  left join small_tests t on t.idema = f.idema and t.fold_id = f.fold_id and t.step = f.step),
small_pairs as (select * from small_pred where actual is not null)"""

_YEAR_GRID = "select * from grid"
_DAY_GRID = """select fold_id, year(cutoff) as year, cutoff
  from (values (1, date '1998-03-13'), (2, date '2000-02-25')) v(fold_id, cutoff)"""

_DEFECTS = {
    1: "Unsupported manifest version: 99",
    2: "manifest.version must be an int",
    3: "manifest.model_name must be a str",
    4: "manifest.seed must be an int",
    5: "manifest min_date and max_date must be ISO date strings",
    6: "manifest.forecast_horizon must be an int",
    7: "manifest.feature_columns must be a list of str",
    8: "manifest.additional_date_features must be a list of str",
}


def _clean_columns() -> str:
    return ", ".join(_six(c, c) for c in NUMBER_FIELDS.values()) + ", wind_direction"


def oracle_sql() -> dict[str, str]:
    latest = _with() + f"\nselect {_KEYS} from latest"
    scores = _clean(_GRID, _standin(14), _scores("pairs_14"))
    small = _clean(_GRID, _SMALL % _YEAR_GRID)
    six_scores = "round(mae + 1.37e-8, 6) mae, round(rain_error + 1.37e-8, 6) rain_error"
    texts = {
        "upsert_latest": latest,
        "network_upsert": _with(base=_LINES) + f"\nselect {_KEYS} from latest",
        "store_upsert": _with(
            f"""halves as (
  select *, row_number() over (
    partition by idema, fecha order by arrival % 2 desc, arrival desc) h from raw)"""
        )
        + f"\nselect {_KEYS} from halves where h = 1",
        "line_import": latest,
        "stream_upsert": latest,
        "upsert_counts": _with()
        + "\nselect substring(fecha, 1, 4) path, cast(count(*) as int) records from raw group by all",
        "station_range_scan": latest + "\nwhere fecha between '1996-03-01' and '2000-02-29'",
        "shard_import": _clean() + f"\nselect idema, date, {_clean_columns()} from clean",
        "import_counts": _with()
        + """
select concat('station=', idema, '/year=', substring(fecha, 1, 4)) shard,
       cast(count(*) as int) records
from latest group by all""",
        "tolerant_import": _with()
        + """,
shards as (select idema, substring(fecha, 1, 4) y, count(*) n from latest group by all)
select concat('station=', idema, '/year=', y) shard,
       cast(case when cast(y as int) % 4 in (1, 2) then 0 else n end as int) records,
       case cast(y as int) % 4 when 1 then 'not valid JSON' when 2 then 'not a JSON array' end error
from shards""",
        "unreadable_readings": _with()
        + "\nselect idema, fecha, 'hrMedia' field, '77%' as text from latest where hrMedia = '77'",
        "clean_daily": _clean() + f"\nselect idema, date, {_clean_columns()} from clean",
        "impute_mean": _with(_PARSED)
        + "\nselect idema, "
        + ", ".join(
            _six(f"coalesce(avg({c}), 0)", c)
            for c in (*NUMBER_FIELDS.values(), "wind_direction")
        )
        + " from parsed group by idema",
        "wind_sector": _with(_PARSED, base=_LINES)
        + "\nselect idema, date, cast(wind_direction as int) sector from parsed",
        "calendar_features": _with(_PARSED)
        + """
select idema, date, cast(dayofyear(date) as int) day_of_year,
       cast(week(date) as int) week_of_year, cast(month(date) as int) as month,
       cast(year(date) as int) as year, cast(quarter(date) as int) as quarter
from parsed""",
        "bulk_lag": _clean()
        + "\nselect idema, date, "
        + ", ".join(
            _six(_bulk_lag("precipitation", n), f"precipitation_lag_{n}d") for n in (1, 14, 20)
        )
        + " from clean",
        **{
            f"bulk_roll_{kind}": _clean()
            + "\nselect idema, date, "
            + _six(_bulk_roll("precipitation", 14, kind), f"precipitation_rolling_14d_{kind}")
            + ", "
            + _six(_bulk_roll("average_humidity", 25, kind), f"average_humidity_rolling_25d_{kind}")
            + " from clean"
            for kind in _FUNCTIONS
        },
        "leak_free_roll": _clean()
        + "\nselect idema, date, "
        + _six(_bulk_roll("precipitation", 14, "std", "before"), "precipitation_rolling_14d_std")
        + " from clean",
        "feature_table": _features(_ORDERS),
        "network_features": _features(_LINES),
        "short_series": _with(base=_LINES)
        + "\nselect idema, cast(count(*) as int) as rows from latest group by 1 having count(*) <= 440",
        "seasonality_7d": _seasonality(_ORDERS),
        "network_seasonality": _seasonality(_LINES),
        "trailing_window": _with(base=_LINES)
        + """
select l.idema, l.fecha, prec, hrMedia
from latest l join (select idema, cast(max(fecha) as date) last from raw group by 1) m
  on m.idema = l.idema
where cast(fecha as date) >= last - 51""",
        "inference_window": _clean(_YEAR_ENDS)
        + """
select l.idema, e.cutoff, l.fecha, l.prec
from latest l join ends e on e.idema = l.idema
where cast(l.fecha as date) between e.cutoff - 51 and e.cutoff + 14""",
        "backfill_tiles": _with(
            """tiles as (
  select idema, 1 tile, s, cast(least(s + interval 6 month, e) as date) t, e
  from (select idema, min(cast(fecha as date)) s, max(cast(fecha as date)) e
        from raw group by 1) where s < e
  union all
  select idema, tile + 1, t + 1, cast(least(t + 1 + interval 6 month, e) as date), e
  from tiles where t + 1 < e)""",
            base=_LINES,
        )
        + '\nselect idema, cast(tile as int) tile, s as start, t as "end" from tiles',
        "resolve_cutoffs": _with(base=_LINES)
        + "\nselect idema, max(cast(fecha as date)) cutoff from raw group by 1",
        "train_test_counts": _with(base=_LINES)
        + """
select idema,
  cast(count(*) filter (where fecha <= '1999-06-30') as int) train,
  cast(count(*) filter (where fecha > '1999-06-30') as int) test
from latest where fecha between '1995-06-01' and '1999-07-14' group by 1""",
        "asof_lag": _asof([("precipitation", "lag", n) for n in (1, 14, 20)]),
        "asof_roll_std": _asof([("precipitation", "std", n) for n in (3, 14)]),
        "asof_roll_all": _asof(
            [(c, k, 9) for c in ("precipitation", "average_humidity") for k in ("lag", *_FUNCTIONS)]
        ),
        "network_asof": _asof(_ASOF_DEFAULT, base=_LINES),
        "future_features": _asof(
            _ASOF_DEFAULT,
            base=_LINES,
            targets="ahead",
            extra=", cast(dayofyear(t.date) as int) day_of_year, cast(quarter(t.date) as int) as quarter",
            ctes=(
                """ahead as (
  select idema, cast(last + cast(k as int) as date) date
  from (select idema, max(date) last, unnest(range(1, 15)) k from clean group by 1))""",
            ),
        ),
        "fold_grid": _clean(_GRID)
        + """
select t.idema, g.fold_id, g.year, g.start_day, g.cutoff, cast(count(*) as int) n
from tests t join grid g on g.fold_id = t.fold_id group by all""",
        "fold_scores": scores + f"\nselect idema, fold_id, n, {six_scores} from scores",
        "network_fold_scores": _clean(_GRID, _standin(14), _scores("pairs_14"), base=_LINES)
        + f"\nselect idema, fold_id, n, {six_scores} from scores",
        "fold_scores_by_date": _clean(
            _GRID,
            _standin(14),
            """by_date as (select s.*, t.actual from standin_14 s join tests t
  on t.idema = s.idema and t.fold_id = s.fold_id and t.date = s.date)""",
            _scores("by_date"),
        )
        + f"\nselect idema, fold_id, n, {six_scores} from scores",
        "window_report": scores
        + """
select idema, round(rain_error + 1.37e-8, 6) custom_rain_error, round(mae + 1.37e-8, 6) mae_error,
       cast(cutoff + 1 as date) period_start, cast(cutoff + 14 as date) period_end
from scores""",
        "cv_summary": _clean(_GRID, _standin(14), _scores("pairs_14"), _SUMMARY)
        + f"\nselect config_id, idema, {six_scores}, round(mae_std + 1.37e-8, 6) mae_std from summary",
        "residuals": _clean(_GRID, _standin(14), base=_LINES)
        + """
select idema, fold_id, cast(step as int) step, round(actual - prediction + 1.37e-8, 6) residual
from pairs_14""",
        "residual_spread": _clean(_GRID, _standin(14))
        + """
select config_id, idema, cast(step as int) step, round(stddev_pop(actual - prediction) + 1.37e-8, 6) sd
from pairs_14 group by all""",
        "forecast_band": _clean(
            _GRID,
            _standin(14),
            _SPREAD,
            """bands as (select p.*, greatest(prediction - sd, 0e0) lo, prediction + sd hi
  from pairs_14 p join spread s on s.step = p.step)""",
        )
        + f"""
select idema, fold_id, cast(step as int) step, round(prediction + 1.37e-8, 6) prediction,
       round(lo + 1.37e-8, 6) lower_band, round(hi + 1.37e-8, 6) upper_band,
       {_LEVEL.format("prediction")} as level, {_LEVEL.format("lo")} lower_level,
       {_LEVEL.format("hi")} upper_level
from bands""",
        "severity_levels": _clean(base=_LINES)
        + f"""
select idema, {_LEVEL.format("precipitation")} as level, cast(count(*) as int) as days
from clean group by all""",
        "context_slice": _clean(_YEAR_ENDS, _CONTEXT)
        + "\nselect idema, cutoff, date, round(precipitation + 1.37e-8, 6) precipitation from context",
        "chart_days": _clean(_YEAR_ENDS, _CONTEXT)
        + """
select idema, cutoff, date from context
union
select idema, cutoff, cast(cutoff + cast(k as int) as date)
from (select *, unnest(range(1, 15)) k from ends)""",
        "leaderboard_topk": _clean(
            _GRID,
            *[_standin(n) for n in (14, 16, 18, 20)],
            "pairs as ("
            + " union all ".join(f"select * from pairs_{n}" for n in (14, 16, 18, 20))
            + ")",
            _scores("pairs"),
            _SUMMARY,
            """ranked as (select *, row_number() over (
  partition by idema order by mae, config_id) place from summary)""",
        )
        + f"""
select config_id, idema, {six_scores}, round(mae_std + 1.37e-8, 6) mae_std, cast(place as int) as rank
from ranked where place <= ceil(4 * 0.6)""",
        "recursive_linear_forecast": _clean(_GRID, _RECURSION)
        + """
select w.idema, w.fold_id, w.cutoff, cast(w.step as int) step,
       cast(w.cutoff + w.step as date) date, round(w.prediction + 1.37e-8, 6) prediction,
       round(t.actual + 1.37e-8, 6) actual
from walk w left join tests t
  on t.idema = w.idema and t.fold_id = w.fold_id and t.step = w.step
where w.step > 0""",
        "expanding_ols_forecast": small
        + """
select idema, fold_id, step, date, round(prediction + 1.37e-8, 5) prediction, round(actual + 1.37e-8, 5) actual
from small_pred""",
        "date_forecasts": _clean(
            _GRID,
            _SMALL % _DAY_GRID,
            _SPREAD,
            """bands as (select p.*, greatest(prediction - sd, 0e0) lo, prediction + sd hi
  from small_pred p join spread s on s.step = p.step)""",
        )
        + f"""
select idema, cutoff, step, date, round(prediction + 1.37e-8, 5) prediction,
       round(actual + 1.37e-8, 5) actual, round(lo + 1.37e-8, 5) lower_band,
       round(hi + 1.37e-8, 5) upper_band, {_LEVEL.format("prediction")} as level,
       {_LEVEL.format("lo")} lower_level, {_LEVEL.format("hi")} upper_level
from bands""",
        "ols_summary": _clean(_GRID, _SMALL % _YEAR_GRID, _scores("small_pairs"), _SUMMARY)
        + """
select config_id, idema, round(mae + 1.37e-8, 5) mae, round(mae_std + 1.37e-8, 5) mae_std,
       round(rain_error + 1.37e-8, 5) rain_error
from summary""",
        "ols_importance": small
        + """,
weights as (
  select idema, abs(bx) * sqrt(vx) wx, abs(bd) * sqrt(vd) wd from fits)
select 'small' config_id, idema, unnest(['precipitation_lag_14d', 'day_of_year']) feature,
       round(unnest([avg(case when wx + wd > 0 then wx / (wx + wd) else 0 end),
                     avg(case when wx + wd > 0 then wd / (wx + wd) else 0 end)]) + 1.37e-8, 6) importance
from weights group by idema""",
        "tree_fold_scores": _clean(
            """trained as (select idema, date, precipitation from clean where rn > 25),
firsts as (select distinct cast(date_trunc('quarter', date) as date) - 1 cutoff from clean),
means as (
  select idema, cast(cutoff as date) cutoff, avg(precipitation) mean
  from firsts join trained on date <= cutoff group by all)"""
        )
        + """
select m.idema, cast(count(distinct cutoff) as int) folds, cast(count(*) as int) as days,
       round(avg(abs(precipitation - mean)) + 1.37e-8, 6) mean_error, cast(1 as int) sound
from means m join trained t on t.idema = m.idema and t.date > cutoff and t.date <= cutoff + 14
group by all""",
        **{
            name: _clean("""trained as (select * from clean where rn > 25),
after_ as (
  select idema, precipitation, row_number() over (partition by idema order by date) step
  from trained where date > date '1999-06-30' and date <= date '1999-07-14')""")
            + """
select s.idema, cast(s.step as int) step, cast(date '1999-06-30' + cast(s.step as int) as date) date,
       round(a.precipitation + 1.37e-8, 5) actual, cast(1 as int) usable
from (select *, unnest(range(1, 15)) step
      from (select distinct idema from trained where date <= date '1999-06-30')) s
left join after_ a on a.idema = s.idema and a.step = s.step"""
            for name in ("gbt_forecast", "tweedie_forecast")
        },
        "manifest_validate": "with checked as (select c_custkey, case c_custkey % 9 "
        + " ".join(f"when {k} then '{m}'" for k, m in _DEFECTS.items())
        + """ end error from customer)
select c_custkey, error,
       case when error is null then 'BoostedTrees' end model_name,
       case when error is null then cast(28 as bigint) end seed,
       case when error is null then 14 end forecast_horizon
from checked""",
    }
    # Names from when the plain ones were limited to some years.
    texts["store_trailing_window"] = texts["trailing_window"]
    texts |= {f"{name}_all": texts[name] for name in ("expanding_ols_forecast", "ols_summary", "ols_importance")}
    return texts
