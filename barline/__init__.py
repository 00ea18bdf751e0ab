"""barline: market-bar analytics as PySpark DataFrame operators."""
