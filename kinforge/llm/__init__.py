"""Training-data operators: scanning, extraction, filtering, dedup and mixing."""
