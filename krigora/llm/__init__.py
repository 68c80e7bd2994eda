"""Training-data pipeline operators (quality, dedup, sharding, mixing, packing, language, PII)."""
