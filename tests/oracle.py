"""Compare registered queries with their SQL. Run as a script: python tests/oracle.py [sf_dir] [query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    "timestamp": "time", "timestamp_ntz": "time",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(name: str) -> str:
    name = name.lower()
    return "decimal" if name.startswith("decimal") else KINDS.get(name, name)


def _key(row):
    return tuple("" if v is None else repr(v) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(df, con, sql: str) -> list[str]:
    """Differences in column names, types, number of rows and values."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    types = {d[0]: kind(d[1]) for d in described}
    rows = con.execute(sql).fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, dtype in df.dtypes:
        if kind(dtype) != types[name]:
            problems.append(f"type of {name}: {dtype} against {types[name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = sorted((tuple(r[i] for i in at) for r in rows), key=_key)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    if len(want) != len(got):
        problems.append(f"rows {len(got)} against {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    if wrong:
        problems.append(f"{len(wrong)} of {len(want)} rows differ; {order}; first got {wrong[0][0]} want {wrong[0][1]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from spendkit.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(e.queries())
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf_dir), e.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            df = e.queries()[name](spark, sf_dir)
            if name in checks:
                problems, n = compare(df, con, checks[name]), ""
            else:
                problems, n = [], f"(no SQL, {df.count()} rows)"
        except Exception as error:  # noqa: BLE001
            problems, n = [str(error)[:1500]], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {n} {' | '.join(problems)}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
