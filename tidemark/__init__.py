"""Prequential graph analytics and large-scale data operators on Spark."""

__version__ = "0.1.0"
