"""Training-data operators: fingerprints, deduplication, filters, tokens, extraction, mixing and scoring."""
