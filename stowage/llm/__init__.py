"""Training-data operators: deduplication, filtering, scoring and packing of documents on Spark."""
