"""Registration of queries in a module."""

from __future__ import annotations

import re

from weft.operators import sql
from weft.sources.catalog import TABLES, table

__all__ = ["Catalog", "table"]


class Catalog:
    """Named queries and the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a builder (spark, sf_dir) -> DataFrame, and its SQL twin if there is one."""

        def keep(f):
            if name in self.queries:
                raise ValueError(f"registered twice: {name}")
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return keep

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Registers a query given in the dialect; its twin is the same text unless dialects differ."""

        names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

        def run(spark, sf_dir):
            return sql.run(spark, text, lambda n: table(spark, sf_dir, n), names)

        self.query(name, oracle or text)(run)
