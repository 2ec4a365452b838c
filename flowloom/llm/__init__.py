"""Training-data operators: deduplication, filtering, tokenisation and packing of document tables."""
