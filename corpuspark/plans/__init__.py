"""corpuspark.plans."""
