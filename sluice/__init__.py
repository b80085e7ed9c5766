"""sluice: SQL dump files to typed, reconciled tables, as Spark jobs."""

from sluice.plans.migrate import infer_schema, migrate, plan_migration

__all__ = ["infer_schema", "migrate", "plan_migration"]
