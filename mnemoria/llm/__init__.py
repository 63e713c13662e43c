"""Training-data operators: deduplication, filtering, formatting, counting and mixing."""
