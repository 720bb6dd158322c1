"""textlab: text-classification data work on Spark."""

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so a job also runs
# where the package is not installed on the executors.
cloudpickle.register_pickle_by_value(__import__(__name__))
