"""Imports every query module so the registry is complete."""

from __future__ import annotations

from gapscope.plans import benchmark, gapviews, io, irt, layouts, logits, merges, process, prompting, scores, text  # noqa: F401
from gapscope.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
