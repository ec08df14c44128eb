"""tracemill: session-log analytics expressed as PySpark DataFrame plans."""
