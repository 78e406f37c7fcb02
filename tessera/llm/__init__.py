"""Training-data pipeline operators: language ID, extraction, dedup, tokens, search, packing."""
