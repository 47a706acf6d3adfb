"""Collects every registered query."""

from netreach.registry import q_eval, q_graph, q_io, q_network, q_od, q_risk, q_select  # noqa: F401
from netreach.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
