"""barloom: panel analytics on Spark for daily (ticker, date) data."""

__version__ = "0.1.0"
