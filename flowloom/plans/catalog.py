"""Imports every query module once, so the registry is complete."""

from . import q_capture, q_flows, q_metrics, q_models, q_profile, q_rules, q_stream, q_tables, q_windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
