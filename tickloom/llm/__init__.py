"""Training-data operators on Spark: dedup, tokenising, formatting, filtering, mixing."""
