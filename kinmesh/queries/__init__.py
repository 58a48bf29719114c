"""All queries of the identity library: name -> function, name -> SQL."""

from __future__ import annotations

from kinmesh.queries import audits, evaluation, identity, truths


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for module in (identity, evaluation, truths, audits):
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
