"""Column builders: tokenizers and similarity measures."""
