"""Code-intelligence analytics and training-data operators on Spark."""

__version__ = "0.2.0"
