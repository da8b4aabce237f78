"""retailops: retail sales analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or a dict of lazy
DataFrames); nothing is collected to the driver inside an operator core.
"""

__version__ = "0.1.0"
