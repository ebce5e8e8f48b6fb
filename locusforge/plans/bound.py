"""All bound queries."""

from locusforge.plans import (
    bound_evidence,
    bound_functions,
    bound_genetics,
    bound_manifests,
    bound_sources,
    bound_steps,
)  # noqa: F401
from locusforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
