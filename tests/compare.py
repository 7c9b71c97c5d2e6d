"""Run registered queries next to their SQL and compare whole results.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from examlake.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(spark, con, sf_dir: str, name: str) -> tuple[list[str], int]:
    """What differs between the two results (empty when equal), and the row count."""
    df = contract.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return [], len(rows)
    result = con.execute(sql)
    names, types = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(set(names) ^ set(df.columns))}")
        return problems, len(rows)
    spark_types = {c: KINDS.get(t, t) for c, t in df.dtypes}
    odd = {n: (spark_types[n], t) for n, t in zip(names, types) if spark_types[n] != t}
    if odd:
        problems.append(f"types {odd}")
    if len(rows) != len(expected):
        problems.append(f"rows {len(rows)} != {len(expected)}")
    got, want = canonical(df.columns, rows), canonical(names, expected)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ")
        problems += [f"   spark {g}\n   sql   {w}" for g, w in bad[:2]]
    return problems, len(rows)


if __name__ == "__main__":
    folder, wanted = sys.argv[1], sys.argv[2:]
    session, db = local_session("8"), connect(folder)
    failed = []
    for query in wanted or contract.queries():
        start = time.time()
        try:
            found, count = differences(session, db, folder, query)
        except Exception as error:  # noqa: BLE001
            found, count = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        print(f"{query:26s} {count:7d} rows {time.time() - start:6.2f}s {'ok' if not found else 'DIFF'}", flush=True)
        for line in found:
            print("  ", line, flush=True)
        failed += [query] if found else []
    print(len(failed), "failed:", failed)
