"""Operators of a training-data pipeline: near duplicates, filters, decontamination and packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job; they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
