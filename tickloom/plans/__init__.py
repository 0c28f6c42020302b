"""Planning: splits, samples, shards, commits and the query catalogue."""
