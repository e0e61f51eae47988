"""factloom: a Spark-native engine for hypothesis-driven evidence analysis."""

__version__ = "0.1.0"
