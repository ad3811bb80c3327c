"""Operators of a training-data pipeline: deduplication, quality, language, decontamination, tokens."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
