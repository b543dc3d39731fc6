"""Spark-native analytics over annotated sequences, structures and hierarchies.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing
here needs an RDD; Python runs only where a numeric kernel cannot be written as
a Catalyst expression, and then over Arrow batches.
"""

__version__ = "0.1.0"
