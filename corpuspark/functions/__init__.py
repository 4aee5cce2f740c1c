"""corpuspark.functions."""
