"""Imports every query module so that all keys are registered."""
from . import q_findings, q_fleet, q_more, q_normalize, q_ops, q_scan  # noqa: F401
