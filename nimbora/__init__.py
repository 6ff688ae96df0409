"""Daily weather-station analytics on Spark: ingest, clean, feature, forecast, evaluate."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its few Python helpers travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
