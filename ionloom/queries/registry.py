"""All registered queries by name."""

from __future__ import annotations

from ionloom.queries.base import Query


def _collect() -> dict[str, Query]:
    from ionloom.queries import (
        q_aggregates,
        q_curation,
        q_generators,
        q_joins,
        q_library,
        q_projections,
        q_scans,
        q_streaming,
        q_windows,
    )

    out: dict[str, Query] = {}
    for module in (
        q_scans,
        q_projections,
        q_generators,
        q_joins,
        q_aggregates,
        q_curation,
        q_windows,
        q_library,
        q_streaming,
    ):
        for query in module.BOOK.queries:
            if query.name in out:
                raise ValueError(f"query {query.name!r} is registered twice")
            out[query.name] = query
    return out


QUERIES: dict[str, Query] = _collect()
