"""Training-data operators: mixing, dedup, packing, scoring, filtering, extraction."""
