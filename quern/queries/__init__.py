"""Registered queries of the library's own operators, by theme, with the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Theme:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def every() -> tuple[dict[str, Query], dict[str, str]]:
    from . import core, data, more

    themes = [core.q, data.q, more.q]
    queries, sql = {}, {}
    for t in themes:
        queries |= t.queries
        sql |= t.sql
    return queries, sql
