"""Training-data pipeline operators: sharding, mixing, dedup, scans, decontamination, output."""
