"""Training-data operators: search, quality, mixing, near-duplicates, HTML, toxicity, secrets and tokens."""
