"""Training-data operators: tokenising, filtering, deduplication, packing and formatting."""
