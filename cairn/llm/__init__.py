"""Training-data operators: tokenisation, deduplication, filtering, decontamination."""
