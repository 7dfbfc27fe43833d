"""Every query of the engine by name, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandkeep.plans import contents, diffs, disk, histories, overviews, policies, primitives, snapshots, workspaces

MODULES = (diffs, policies, histories, contents, overviews, snapshots, workspaces, primitives, disk)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
