"""PySpark-native analytics for network-security telemetry."""
