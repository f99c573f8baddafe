"""tidewater: Spark-first feature, time-series and ensemble operators for event data."""
