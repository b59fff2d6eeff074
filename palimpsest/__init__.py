"""palimpsest: dataset audit, similarity and leakage-safe evaluation on PySpark."""

__version__ = "0.1.0"
