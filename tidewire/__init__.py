"""tidewire: a Spark-native engine for feed and document streams."""
