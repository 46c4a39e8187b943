"""Training-data operators: cleaning, scoring, deduplication and mixing of text corpora."""
