"""A book of queries: each a DataFrame function, most with the SQL that must give the same rows."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
