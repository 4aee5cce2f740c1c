"""corpuspark: document-corpus analytics as Spark jobs (DataFrame, SQL and Structured Streaming)."""
