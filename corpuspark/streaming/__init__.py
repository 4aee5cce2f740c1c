"""corpuspark.streaming."""
