"""Training-data operators: deduplication, packing, mixing, filtering and token output."""
