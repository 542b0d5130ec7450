"""watchgrid: a PySpark-native analytics engine for monitoring data."""
