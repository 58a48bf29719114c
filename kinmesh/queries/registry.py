"""The decorator that registers a query with its SQL."""

from __future__ import annotations

from kinmesh.queries.base import Steps, with_steps


def registrar():
    queries, oracles = {}, {}

    def query(sql: str | None = None, *steps: str):
        """Register a function of Steps under its name, with its SQL over the named steps."""

        def add(f):
            def run(spark, sf_dir):
                return f(Steps(spark, sf_dir))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = run
            if sql:
                oracles[f.__name__] = with_steps(sql, *steps) if steps else sql
            return f

        return add

    return query, queries, oracles
