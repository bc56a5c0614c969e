"""tidemark: a Spark-native temporal memory and corpus-processing engine."""

__version__ = "0.1.0"
