"""Business-analytics operators for Spark: DataFrames and parameters in, DataFrame out."""
