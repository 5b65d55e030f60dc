"""All registered queries."""

from unitcal.plans import (  # noqa: F401  (importing registers the queries)
    audit_queries,
    collision_queries,
    conformal_queries,
    feature_queries,
    model_queries,
    score_queries,
    series_queries,
)
from unitcal.plans.registry import CATALOG

__all__ = ["CATALOG"]
