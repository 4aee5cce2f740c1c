"""corpuspark.sources."""
