"""Training-data operators: deduplication, decontamination, mixing, search, scoring and scans.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
