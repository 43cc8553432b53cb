"""Named queries over the given tables, each with independent SQL for the same rows."""

from tallychain.registry import metric_checks, operator_checks, reshape_checks  # noqa: F401
from tallychain.registry.base import CHECKS

__all__ = ["CHECKS"]
