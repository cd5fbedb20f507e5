"""factloom: Spark-native answer verification, evaluation analytics and corpus preparation."""

__version__ = "0.1.0"
