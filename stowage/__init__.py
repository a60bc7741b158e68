"""Content-addressed file analytics on Spark: entries, chunks, archives, images and pipelines as DataFrames."""
