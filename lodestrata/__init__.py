"""A Spark-native analytics engine for immutable columnar archives."""
