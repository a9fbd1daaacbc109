"""Training-data operators: filtering, deduplication, extraction, packing and output of text corpora."""
