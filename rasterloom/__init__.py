"""rasterloom: raster time-series analytics as Spark DataFrame queries."""

__version__ = "0.1.0"
