"""PySpark-native analytics for page-layout data."""
