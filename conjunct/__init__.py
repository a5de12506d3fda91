"""conjunct: a Spark-first engine for pattern regression over item sets."""

__version__ = "0.1.0"
