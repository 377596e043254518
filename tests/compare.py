"""Run registered queries next to their DuckDB SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a query; empty when they agree."""
    result = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = result.fetchall()
    ours = df.collect()
    problems = []
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if kinds != mine:
        problems.append(f"schema: spark {sorted(mine.items())} duckdb {sorted(kinds.items())}")
    if set(kinds) != set(mine):
        return problems
    names = sorted(mine)
    at = {name: i for i, name in enumerate(kinds)}
    a = Counter(tuple(_cell(row[n]) for n in names) for row in ours)
    b = Counter(tuple(_cell(row[at[n]]) for n in names) for row in theirs)
    if len(ours) != len(theirs):
        problems.append(f"rows: spark {len(ours)} duckdb {len(theirs)}")
    if not len(ours):
        problems.append("empty result")
    exact_a = Counter(tuple(row[n] for n in names) for row in ours)
    exact_b = Counter(tuple(row[at[n]] for n in names) for row in theirs)
    if a == b and exact_a != exact_b:
        problems.append(f"last bits: {list((exact_a - exact_b).items())[:2]} {list((exact_b - exact_a).items())[:2]}")
    if a != b:
        problems.append(f"values: only spark {list((a - b).items())[:3]} only duckdb {list((b - a).items())[:3]}")
    return problems


if __name__ == "__main__":
    import __spark_entry__ as entry
    from binroute.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.oracle_sql())
    spark = local_session(8)
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            problems = compare(df, con, sqls[name])
            size = df.count() if problems else ""
        except Exception as error:  # noqa: BLE001
            problems, size = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{name:32}{time.time() - start:6.1f}s {size} {problems or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
