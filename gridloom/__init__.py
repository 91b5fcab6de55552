"""Spatial statistics on Spark: meshes, sparse systems, random fields and marginals as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
