"""Training-data operators: mixing, privacy, toxicity, sharding, quality, dedup, packing, language ID."""
