"""The telemetry pipeline over streams."""
