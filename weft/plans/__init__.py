"""Registered queries over the standard tables, with the SQL that must give the same rows."""

from . import activity, changes, conflicts, coupling, evidence, fields, graph, listings, relations, relevance, reviewers, rollups, search, series, shape, spectrum, tags, text, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
