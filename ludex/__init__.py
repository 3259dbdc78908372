"""ludex: implicit-feedback recommendation analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function or a ``fit`` /
``apply`` pair whose fitted state is a small DataFrame saved as parquet.
"""

__version__ = "0.1.0"
