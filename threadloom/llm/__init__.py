"""Training-data pipeline operators: dedup, sharding, mixing, packing, search, archives, language ID."""
