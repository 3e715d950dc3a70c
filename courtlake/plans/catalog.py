"""All registered queries."""
from . import q_asof, q_court, q_identity, q_intervals, q_quality, q_segments, q_sources, q_store, q_streams  # noqa: F401
from .registry import IDS, ORACLES, QUERIES  # noqa: F401
