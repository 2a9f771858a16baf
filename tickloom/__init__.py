"""tickloom: market time-series analytics as Spark DataFrame operators."""
