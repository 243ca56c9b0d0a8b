"""Traceability analytics over specification corpora, as PySpark DataFrame functions."""
