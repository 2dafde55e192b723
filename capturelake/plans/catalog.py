"""All registered queries; importing this module registers every family."""

from __future__ import annotations

from . import claims, entries, evaluate, facts, history, pii, structure, text, usage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
