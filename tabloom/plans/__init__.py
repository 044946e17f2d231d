"""Importing this package registers every query."""

from tabloom.plans import aggregations, features, joins, metrics, models, projections, retrieval, scalars, storage, text, windows  # noqa: F401
from tabloom.plans.registry import ORACLES, QUERIES  # noqa: F401
