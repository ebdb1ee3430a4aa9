"""Training-data operators: scoring, scanning, matching, tokenising and packing documents."""
