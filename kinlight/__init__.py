"""kinlight: a PySpark-native analytics engine for media-library style tables."""
