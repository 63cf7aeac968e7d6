"""Registered queries of the grid operators."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    from . import composites, patches, spatial, tables  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
