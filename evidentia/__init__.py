"""evidentia: a PySpark-native analytics engine for noisy document evidence."""
