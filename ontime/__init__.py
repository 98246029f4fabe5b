"""Flight-delay analytics on Spark: DataFrame in, DataFrame out."""
