"""weft: co-occurrence, relevance, text and event analytics as Spark jobs."""

__version__ = "0.1.0"
