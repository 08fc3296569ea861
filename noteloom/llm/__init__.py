"""Training-data operators: extraction, deduplication, tokens, quality, privacy, mixing, search."""
