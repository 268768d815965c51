"""Training-data operators: sharding, mixing, language ID, deduplication, licence scans, LM scoring, packing."""
