"""Finance-review operators on Spark: DataFrame in, DataFrame out."""
