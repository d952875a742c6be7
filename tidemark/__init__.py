"""Offer-intelligence analytics on Spark: text to curated, queryable catalogue."""
