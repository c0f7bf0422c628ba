"""Class analytics on Spark: pure DataFrame -> DataFrame operators."""
