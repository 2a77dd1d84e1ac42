"""Training-data operators: scoring, near-duplicates, search, packing, mixing, sharding,
token files, sanitisation, quality ledgers and web archives, as Spark jobs."""
