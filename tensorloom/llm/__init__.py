"""Training-data operators: sharding, deduplication, tokenising, language ID, scans."""
