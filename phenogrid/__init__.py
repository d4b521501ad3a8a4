"""A Spark-native engine for morphological profiles."""
