"""pairsmith: record linkage and corpus processing as declarative Spark plans."""
