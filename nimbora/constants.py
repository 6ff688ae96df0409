"""Names and fixed values shared by the whole package."""

# ---------------------------------------------------------------------------
# Raw field names of a station record and the clean column each
# one becomes. They have to stay as they are for existing data to load.
# ---------------------------------------------------------------------------
STATION_FIELD = "indicativo"
DAY_FIELD = "fecha"

NUMBER_FIELDS = {
    "prec": "precipitation",
    "tmed": "average_temperature",
    "tmin": "min_temperature",
    "tmax": "max_temperature",
    "velmedia": "average_wind_speed",
    "racha": "max_wind_gust",
    "presMax": "max_pressure",
    "presMin": "min_pressure",
    "hrMedia": "average_humidity",
    "sol": "sunshine",
}
WIND_FIELD = "dir"
METRIC_FIELDS = (*NUMBER_FIELDS, WIND_FIELD)

RAIN_CODES = {"Ip": 0.05, "Acum": 0.0}
WIND_SENTINELS = (88.0, 99.0)
SECTOR_DEGREES = 45

# ---------------------------------------------------------------------------
# Clean schema, calendar names and forecasting defaults.
# ---------------------------------------------------------------------------
KEY = "idema"
DAY = "fecha"
DATE = "date"
TARGET = "precipitation"
WIND_DIRECTION = "wind_direction"
BASE_COLUMNS = (*NUMBER_FIELDS.values(), WIND_DIRECTION)
CLEAN_NAMES = {**NUMBER_FIELDS, WIND_FIELD: WIND_DIRECTION}

SEED = 28
HORIZON = 14
BENCHMARK_YEARS = (1951, 2024)

# Spread of (actual - predicted) in mm for forecast days 1..14.
STEP_SPREAD_MM = (
    7.753461613310481,
    8.64236262051793,
    8.607975573892729,
    6.949425690207271,
    7.312719993199972,
    7.736787647758962,
    7.495041549314444,
    7.389810418776884,
    8.492416456844554,
    7.575075174160229,
    6.751153569483533,
    7.16921973460898,
    7.901264913747243,
    9.960110861955693,
)

# Known stations: (city, station id, folder, shard file prefix, first shard, past-last shard).
STATIONS = (
    ("Bilbao", "1082", "Bilbao", "historical_climate_data_BILBAO", 0, 11),
    ("San Sebastian", "1024E", "SanSebastian", "historical_climate_data_SAN_SEBASTIAN", 1, 7),
    ("Valencia", "8416", "Valencia", "historical_climate_data_Valencia", 1, 8),
    ("Madrid", "3195", "Madrid", "historical_climate_data_Madrid", 1, 8),
    ("Malaga", "6155A", "Malaga", "historical_climate_data_Malaga", 1, 9),
)
