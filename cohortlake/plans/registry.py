"""Registered queries and their SQL."""

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``, with SQL for the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
