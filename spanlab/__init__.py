"""spanlab: a Spark engine for character spans, chunks, retrieval and their evaluation."""

__version__ = "0.3.0"
