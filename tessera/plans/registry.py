"""Queries with their SQL; shared SQL parts are named and put in front of a query that uses them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.functions: dict[str, Query] = {}
        self.bodies: dict[str, str] = {}
        self.parts: dict[str, str] = {}

    def cte(self, name: str, body: str) -> None:
        if name in self.parts:
            raise ValueError(f"two SQL parts are called {name}")
        self.parts[name] = body

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.functions[name] = function
            if sql is not None:
                self.bodies[name] = sql
            return function

        return add

    def _needed(self, sql: str, seen: list[str], open_: tuple[str, ...] = ()) -> list[str]:
        """Parts that ``sql`` names, those they need first; a part may name itself."""
        for name in self.parts:
            if name not in seen and name not in open_ and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                self._needed(self.parts[name], seen, (*open_, name))
                if name not in seen:
                    seen.append(name)
        return seen

    def sql(self, name: str) -> str:
        body = self.bodies[name]
        needed = self._needed(body, [])
        if not needed:
            return body
        kind = lambda n: "" if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", self.parts[n]) else "MATERIALIZED "
        parts = ",\n".join(f"{n} AS {kind(n)}({self.parts[n]})" for n in needed)
        return f"WITH RECURSIVE {parts}\n{body}"

    def oracle_sql(self) -> dict[str, str]:
        return {name: self.sql(name) for name in self.bodies}
