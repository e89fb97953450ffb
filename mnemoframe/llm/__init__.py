"""Training-data operators: scoring, mixing, extraction, dedup, sharding, encoding."""
