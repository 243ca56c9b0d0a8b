"""Operators for preparing training data at scale, and the queries that apply them to the provided tables."""
