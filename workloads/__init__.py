"""Registered queries over the driver tables, each with its check SQL where SQL can state it."""

from workloads import intelligence, learning, scanning, sinks  # noqa: F401
from workloads.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
