"""All registered queries, in one ordered mapping."""

from __future__ import annotations

from swatch.plans import analysis, customers, ingest, merge, reports
from swatch.plans.common import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for mod in _modules():
        for q in mod.queries():
            if q.name in out:
                raise ValueError(f"duplicate query name {q.name}")
            out[q.name] = q
    return out


def _modules():
    return [analysis, merge, customers, ingest, reports]
