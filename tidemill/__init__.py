"""tidemill: a PySpark-native analytics engine."""
