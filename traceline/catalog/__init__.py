"""Registered queries over the provided tables, each with its SQL where SQL can say it."""

from traceline.catalog import changes, evidence, references, reports, rules, texts  # noqa: F401
from traceline.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
