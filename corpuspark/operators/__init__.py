"""corpuspark.operators."""
