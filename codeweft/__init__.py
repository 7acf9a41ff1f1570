"""codeweft: source-code and history analytics expressed as PySpark jobs."""
