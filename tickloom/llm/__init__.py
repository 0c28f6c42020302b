"""Training-data operators: dedup, scans, mixing, packing, sharding, search."""
