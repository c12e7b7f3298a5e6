"""Flow-log attack analytics as Spark DataFrame operators."""
