"""quadrat: sample-by-feature analytics as Spark DataFrame operators."""
