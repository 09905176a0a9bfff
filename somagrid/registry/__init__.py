"""Registered queries and their SQL twins."""

from somagrid.registry.base import ORACLES, QUERIES, load_all

__all__ = ["QUERIES", "ORACLES", "load_all"]
