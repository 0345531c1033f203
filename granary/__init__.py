"""granary: a Spark-native engine that builds, curates and evaluates text corpora."""

__version__ = "0.1.0"
