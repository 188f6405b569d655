"""tidemark: time-series, event and text analytics as Spark DataFrame operators."""
