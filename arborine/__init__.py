"""arborine: code-graph analytics and corpus preparation as plain PySpark jobs."""

__version__ = "0.1.0"
