"""Queries of the library over the driver's tables, with their SQL twins."""

from __future__ import annotations

from boardlake.plans import boards, more, quality_ops, registry, scalars, weekly  # noqa: F401  they register themselves


def all_queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
