"""All named queries."""

from sightline.plans import workloads_core, workloads_more  # noqa: F401
from sightline.plans import workloads_live  # noqa: F401  (after the batch twins it borrows SQL from)
from sightline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
