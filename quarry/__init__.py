"""quarry: document analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

# Functions given to mapInArrow and its kin travel by value, so executors need
# no copy of this package on their own disks.
import quarry as _self

_cloudpickle.register_pickle_by_value(_self)
