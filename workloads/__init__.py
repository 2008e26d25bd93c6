"""Queries over the driver's tables, one or more per operator, each with independent SQL to check it."""

from __future__ import annotations

from workloads import registry


def _load() -> None:
    from workloads import changes, colors, gridding, local, pictures, runs, scenarios, store, sums, zones  # noqa: F401


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
