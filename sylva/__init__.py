"""Forest analytics on Spark: sources, tree operators, schema inference, quality metrics and sinks as DataFrames."""

__version__ = "0.1.0"
