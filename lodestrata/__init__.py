"""Multi-modal analytics on Spark: ordered tables, vectors, blobs, change logs and composite retrieval."""
