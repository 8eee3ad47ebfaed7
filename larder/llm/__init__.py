"""Training-data operators: mixing, fingerprints, quality, packing, sharding, search, dedup, PII, HTML, language."""
