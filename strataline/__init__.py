"""Strataline: a Spark-native engine for knowledge records, session logs and training-data tables."""

import sys

from pyspark import cloudpickle

# Functions and processors that run on executors travel with the job: no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
