"""Operators of a training-data pipeline: cleaning, scoring, deduplicating, tokenising and packing documents."""
