"""vectide: temporal vector analytics and event processing on Spark DataFrames."""

__version__ = "0.1.0"
