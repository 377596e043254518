"""Reading a table in parts, with a stand-in for the connection: nothing is started and no port is opened."""

import datetime as dt
import re

import pytest
from helpers import tuples
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from binroute.operators import filters
from binroute.sources import database, schemas


class Cursor:
    """Understands the two shapes of SQL that the reader sends, over rows held in a list of dicts."""

    def __init__(self, rows, log):
        self.rows, self.log = rows, log

    def execute(self, sql, values):
        with open(self.log, "a") as file:
            file.write(sql + "\n")
        values = list(values)
        where = re.search(r"WHERE (.*?)(?:\) q|$)", sql)[1]
        found = self.rows
        for part in where.split(" AND "):
            name = re.match(r'"([^"]+)"', part)
            if not name:
                assert part == "1 = 1"
                continue
            name, rest = name[1], part[name.end() :].strip()
            if rest.startswith("IS"):
                found = [r for r in found if (r[name] is None) == (rest == "IS NULL")]
                continue
            taken = [values.pop(0) for _ in range(rest.count("?"))]
            tests = {
                "=": lambda x: x == taken[0], ">": lambda x: x > taken[0], ">=": lambda x: x >= taken[0],
                "<": lambda x: x < taken[0], "<=": lambda x: x <= taken[0], "IN": lambda x: x in taken,
            }
            test = tests[rest.split()[0]]
            found = [r for r in found if r[name] is not None and test(r[name])]
        assert not values
        tiles = re.search(r'SELECT MIN\(k\) FROM \(SELECT "(\w+)" AS k, NTILE\((\d+)\)', sql)
        if tiles:
            keys, n = sorted(r[tiles[1]] for r in found), int(tiles[2])
            size, more = divmod(len(keys), n)
            starts = [i * size + min(i, more) for i in range(n) if i * size + min(i, more) < len(keys) and (size or i < more)]
            self.left = [(keys[i],) for i in starts]
        else:
            names = re.findall(r'"(\w+)"', sql.split(" FROM ")[0])
            self.left = [tuple(r[c] for c in names) for r in found]

    def fetchmany(self, n):
        out, self.left = self.left[:n], self.left[n:]
        return out


class Connection:
    def __init__(self, rows, log):
        self.rows, self.log = rows, log

    def cursor(self):
        return Cursor(self.rows, self.log)

    def close(self):
        pass


def skewed():
    """Half the keys are small and dense, the others reach far; some are missing."""
    keys = [*range(500), *(10**6 * i for i in range(1, 400)), *[None] * 20]
    return [
        {"txid": k, "processor_name": f"P{i % 3}", "status": "approved" if i % 2 else None, "error_description": None,
         "created_datetime": dt.datetime(2026, 1, 1 + i % 28, 5), "created_date": dt.date(2026, 1, 1 + i % 28)}
        for i, k in enumerate(keys)
    ]


def load(spark, rows, log, parts=8, schema=schemas.TRANSACTIONS, key="txid"):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return database.read_database(spark, lambda: Connection(rows, log), "attempts", key, schema, parts)


def test_parts_hold_equally_many_rows(spark, tmp_path):
    rows, log = skewed(), str(tmp_path / "sql")
    df = load(spark, rows, log)
    assert tuples(df) == sorted((tuple(r.values()) for r in rows), key=repr)
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 9 and sizes[0] == 20 and sizes[-1] - sizes[1] <= 1  # the rows without a key, and eight like parts


def test_filters_and_columns_reach_the_database(spark, tmp_path):
    rows, log = skewed(), tmp_path / "sql"
    few = database.T.StructType([f for f in schemas.TRANSACTIONS.fields if f.name in ("txid", "status", "created_date")])
    df = filters.in_date_range(load(spark, rows, str(log), schema=few), "2026-01-03", "2026-01-05").where("txid IN (3, 4, 2000000) OR txid IS NULL")
    wanted = [(r["txid"], r["status"], r["created_date"]) for r in rows if r["created_date"].day in (3, 4, 5) and r["txid"] in (3, 4, 2000000, None)]
    assert tuples(df) == sorted(wanted, key=repr) and wanted
    sent = log.read_text().splitlines()
    for sql in sent:
        assert '"created_date" >= ?' in sql and '"created_date" <= ?' in sql
        assert "processor_name" not in sql
    assert any("NTILE(8)" in sql for sql in sent)


def test_few_and_equal_keys(spark, tmp_path):
    log = str(tmp_path / "sql")
    rows = [r | {"txid": 7} for r in skewed()[:50]] + [skewed()[3] | {"txid": None}]
    assert load(spark, rows, log).count() == 51
    assert load(spark, rows[:1], log).count() == 1 and load(spark, [], log).count() == 0
    assert load(spark, rows, log, key="processor_name", parts=2).count() == 51
    with pytest.raises(ValueError):
        load(spark, rows, log, parts=0)


def test_what_is_sent_and_what_is_not():
    name = ("a b",)
    assert database.condition(ds.EqualTo(name, 3)) == database.Condition('"a b" = ?', (3,))
    assert database.condition(ds.LessThan(name, dt.date(2026, 1, 1))).sql == '"a b" < ?'
    assert database.condition(ds.Not(ds.IsNull(name))).sql == '"a b" IS NOT NULL'
    assert database.condition(ds.In(name, (1, None, 2))) == database.Condition('"a b" IN (?, ?)', (1, 2))
    for other in (ds.LessThan(name, "x"), ds.Not(ds.EqualTo(name, 1)), ds.StringContains(name, "x"), ds.EqualTo(("a", "b"), 1), ds.EqualTo(name, None)):
        assert database.condition(other) is None
    assert database.quoted('x"y') == '"x""y"'
