"""Training-data operators: deduplication, similarity joins, archives, packing, scans, models."""
