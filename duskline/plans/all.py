"""All registered queries."""

from . import basics, behaviorq, bounds, details, detection, entities, joins, reports, serieq, streamq  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
