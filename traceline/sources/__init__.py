"""Readers, text extraction jobs, projections of the provided tables, and sinks."""
