"""plumbline: a Spark-native engine for table cleaning, profiling and matching."""

__version__ = "0.1.0"
