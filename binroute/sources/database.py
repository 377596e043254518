"""Database tables in parallel parts of equal size, through any DB-API connection.

``spark.read.jdbc`` cuts the range of a number into even steps: a skewed key fills
one part and leaves the others empty. Here the database itself says where the
quantiles of the key lie, under the filters of the query, so that parts hold
equally many rows. Keys may be of any type that can be ordered. Only the columns
of the given schema are selected, and filters go into the ``WHERE`` of every part.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

FETCH = 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Condition:
    """A piece of SQL with its parameters."""

    sql: str
    values: tuple = ()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(test: ds.Filter) -> Condition | None:
    """A pushed filter as SQL; None for what databases may see differently than Spark."""
    inner = test.child if isinstance(test, ds.Not) else test
    if len(getattr(inner, "attribute", ())) != 1:
        return None
    name = quoted(inner.attribute[0])
    if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
        empty = isinstance(inner, ds.IsNull) != isinstance(test, ds.Not)
        return Condition(f"{name} IS NULL" if empty else f"{name} IS NOT NULL")
    if isinstance(test, ds.Not):
        return None
    for kind, sign in ((ds.EqualTo, "="), (ds.GreaterThan, ">"), (ds.GreaterThanOrEqual, ">="), (ds.LessThan, "<"), (ds.LessThanOrEqual, "<=")):
        # Texts are equal everywhere, but their order is that of the database.
        if type(inner) is kind and inner.value is not None and (kind is ds.EqualTo or not isinstance(inner.value, str)):
            return Condition(f"{name} {sign} ?", (inner.value,))
    if isinstance(inner, ds.In):
        values = tuple(v for v in inner.value if v is not None)
        return Condition(f"{name} IN ({', '.join('?' * len(values))})", values) if values else None
    return None


class Part(ds.InputPartition):
    def __init__(self, condition: Condition):
        super().__init__(condition)
        self.condition = condition


class Reader(ds.DataSourceReader):
    def __init__(self, source: Source, schema: T.StructType):
        self.source, self.schema, self.pushed = source, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for test in filters:
            found = condition(test)
            if found:
                self.pushed.append(found)
            # Spark tests every row again: the database may compare a little differently.
            yield test

    def _where(self, *more: Condition) -> tuple[str, list]:
        all_of = [*self.pushed, *more]
        text = " AND ".join(c.sql for c in all_of) or "1 = 1"
        return text, [v for c in all_of for v in c.values]

    def _rows(self, sql: str, values: list) -> Iterator[list[tuple]]:
        if self.source.placeholder != "?":
            sql = sql.replace("?", self.source.placeholder)
        connection = self.source.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            while rows := cursor.fetchmany(FETCH):
                yield rows
        finally:
            connection.close()

    def partitions(self) -> list[Part]:
        key, n = quoted(self.source.key), self.source.parts
        where, values = self._where(Condition(f"{key} IS NOT NULL"))
        sql = (
            f"SELECT MIN(k) FROM (SELECT {key} AS k, NTILE({n}) OVER (ORDER BY {key}) AS part"
            f" FROM {self.source.table} WHERE {where}) q GROUP BY part ORDER BY 1"
        )
        # A row a part. The first bound only says that there is one: all below the second is in the first part.
        starts = sorted({row[0] for rows in self._rows(sql, values) for row in rows})
        parts = [Part(Condition(f"{key} IS NULL"))]
        for low, high in zip([None, *starts[1:]], [*starts[1:], None], strict=True) if starts else ():
            bounds = [Condition(f"{key} >= ?", (low,))] if low is not None else [Condition(f"{key} IS NOT NULL")]
            bounds += [Condition(f"{key} < ?", (high,))] if high is not None else []
            parts.append(Part(Condition(" AND ".join(b.sql for b in bounds), tuple(v for b in bounds for v in b.values))))
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        where, values = self._where(partition.condition)
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        for rows in self._rows(f"SELECT {names} FROM {self.source.table} WHERE {where}", values):
            yield from rows


class Source(ds.DataSource):
    connect: Callable[[], Any]
    table: str
    key: str
    parts: int
    placeholder: str

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self, schema)


def read_database(
    spark: SparkSession, connect: Callable[[], Any], table: str, key: str, schema: T.StructType, parts: int, placeholder: str = "?"
) -> DataFrame:
    """A table as a DataFrame of up to ``parts`` + 1 partitions.

    ``connect`` returns a new DB-API connection; it is called in the tasks, so it
    must take its secrets from where they run. ``table`` is put into the SQL as it
    is, ``key`` is the column whose quantiles part the rows; rows without a key have
    a part of their own. Rows of one key stay together, so a key that most rows share
    makes one large part. ``placeholder`` is the mark of parameters ("?" or "%s").
    Each part is a query of its own: a table that changes meanwhile needs a
    connection that reads a snapshot.
    """
    if parts < 1:
        raise ValueError("at least one part")
    # Tasks get these classes by value: their machines need not have the package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    facts = {"connect": staticmethod(connect), "table": table, "key": key, "parts": parts, "placeholder": placeholder}
    name = f"binroute_{uuid.uuid4().hex}"
    kind = type("NamedSource", (Source,), facts | {"name": classmethod(lambda cls: name)})
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(kind)
    return spark.read.format(name).schema(schema).load()
