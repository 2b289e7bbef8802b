"""Operators of a training-data pipeline (tokenising, mixing, scoring,
extraction, search, near-duplicate removal).

Nothing else in the package imports this subpackage. Functions that run in
Python workers are shipped with the job (pickled by value), so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
