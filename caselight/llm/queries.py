"""All queries of this package; importing it registers them."""

from caselight.llm import q_canonical, q_leakage, q_names, q_packing, q_pii, q_reading, q_turns  # noqa: F401
from caselight.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
