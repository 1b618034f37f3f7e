"""Plan helpers shared by the operators: scans, materialised tables, parallelism."""

from siltstone.plans.tables import materialize, scan, spread

__all__ = ["materialize", "scan", "spread"]
