"""A Spark-native analytics engine for walk-network density surfaces."""
