"""Operators for training-data corpora: language, toxicity, quality, dedup, decontamination, packing."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
