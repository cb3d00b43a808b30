"""Training-data operators: de-duplication, filtering, scoring and packing of text at scale."""
