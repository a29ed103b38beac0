"""papyra: scholarly retrieval, evaluation and telemetry analytics as Spark DataFrames.

Functions of this package that run in tasks travel with the job, so executors need the libraries but not the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
