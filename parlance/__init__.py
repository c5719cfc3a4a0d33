"""Message-history analytics on Spark: retrieval, scope, directory, rendering and streaming over tables."""
