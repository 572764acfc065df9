"""Tidewatch: time-series anomaly analytics expressed as Spark DataFrame operators."""
