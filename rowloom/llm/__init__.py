"""Operators for training corpora, and the queries that apply them to whole tables."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
