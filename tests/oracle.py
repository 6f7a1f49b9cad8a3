"""Run bound queries in Spark and their SQL in DuckDB and compare the results as bags of rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty text if equal, else what differs."""
    got = query(spark, sf_dir)
    rows = got.collect()
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    expected = want.fetchall()
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} vs {sorted(columns)}"
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in got.schema.fields}
    odd = {c: (types[c], kinds[c]) for c in columns if types[c] != kinds[c] and kinds[c] in KINDS.values()}
    left, right = bag(got.columns, rows), bag(columns, expected)
    if left != right:
        extra, missing = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"rows {len(rows)} vs {len(expected)}; {sorted(columns)}; only Spark {extra}; only SQL {missing}"
    return f"types {odd}" if odd or any(k not in KINDS.values() for k in kinds.values()) else ""


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from cohortry.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, query, sqls[name], sf_dir)
            else:
                problem = f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem}", flush=True)


if __name__ == "__main__":
    main()
