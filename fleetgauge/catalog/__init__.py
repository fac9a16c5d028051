"""Queries over the given tables."""

from fleetgauge.catalog.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from fleetgauge.catalog import (  # noqa: F401
        evaluation,
        files,
        live,
        profiles,
        telemetry,
        texts,
        traces,
        work_grid,
    )

    return QUERIES
