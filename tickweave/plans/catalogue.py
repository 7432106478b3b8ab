"""All analytics queries and the SQL they are compared with."""

from __future__ import annotations

from tickweave.plans import features, folds, models, more, reports  # noqa: F401
from tickweave.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "model_compare"
