"""All queries of the core and their SQL."""

from __future__ import annotations

from loomwright.plans import answering, champions, nested, profiling, relating, searching, shaping, streams, traversing

FLAGSHIP = "rrf_fusion"
PARTS = [profiling, champions, relating, searching, answering, streams, traversing, shaping]
QUERIES = dict(nested.QUERIES)
ORACLES: dict[str, str] = dict(nested.ORACLES)
for _part in PARTS:
    QUERIES |= _part.query.queries
    ORACLES |= _part.query.oracles
