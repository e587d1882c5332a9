"""Typed-graph analytics on Spark: cleaning, building, validating, ranking and evaluating."""
