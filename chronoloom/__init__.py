"""chronoloom: event-stream analytics on regular time grids, as PySpark DataFrame operators."""

__version__ = "0.1.0"
