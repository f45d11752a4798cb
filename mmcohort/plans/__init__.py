"""Query catalog. Importing this package registers every query."""

from mmcohort.plans import end_to_end, evaluation, preparation, storage, training  # noqa: F401
from mmcohort.plans.registry import CATALOG, Query, register, rounded

__all__ = ["CATALOG", "Query", "register", "rounded"]
