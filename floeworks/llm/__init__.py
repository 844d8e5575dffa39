"""Training-data operators on Spark: filters, near-duplicates, search, tokens and mixtures."""
