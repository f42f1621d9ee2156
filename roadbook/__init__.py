"""Vehicle-telemetry analytics as plain PySpark DataFrame transforms."""
