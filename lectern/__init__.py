"""lectern: document-corpus analytics as Spark DataFrame, SQL and streaming jobs."""

__version__ = "0.1.0"
