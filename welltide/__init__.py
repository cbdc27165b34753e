"""welltide: drilling-telemetry analytics as Spark DataFrame jobs, over many wells at once."""
