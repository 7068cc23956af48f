"""Fleet-telemetry anomaly analytics as composable Spark DataFrame operators."""
