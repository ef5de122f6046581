"""All registered queries."""

from . import q_filing, q_ledger, q_model, q_more, q_panel, q_store, q_stream, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
