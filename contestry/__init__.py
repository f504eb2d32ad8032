"""Contest analytics on Spark: ratings, outcome probabilities, market comparison."""
