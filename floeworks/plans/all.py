"""Importing this module fills the registry."""

from . import audits, basics, experiments, files, rasters, reviews, streams, voyages  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
