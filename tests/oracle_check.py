"""Compare registered queries with their SQL counterparts: python -m tests.oracle_check SF_DIR [prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    other = rel.fetchall()
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    bad = [f"{n}: {t} vs {types[n]}" for n, t in df.dtypes if t in TYPE_NAMES and TYPE_NAMES[t] not in types[n].upper() and types[n] not in ("NUMBER", "STRING", "bool", "Date")]
    cols = sorted(names)
    mine = sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=_key)
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in other), key=_key)
    if bad:
        return "types " + "; ".join(bad)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}; e.g. {[m for m in mine if m not in set(theirs)][:2] if len(mine) < 50000 else ''} | {theirs[:2]}"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(diff)}/{len(mine)} rows differ on {cols}, e.g. {diff[0][0]} vs {diff[0][1]}" if diff else ""


def main() -> None:
    from tests.conftest import make_spark
    import __spark_entry__ as entry

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = make_spark(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                res = compare(df, con, oracle[name])
            else:
                n = df.count()
                res = "" if n else "no rows"
            n = "" if name in oracle else f" rows-only {n}"
        except Exception as e:  # noqa: BLE001 - a report tool shows every failure and goes on
            res, n = f"{type(e).__name__}: {str(e)[:int(os.environ.get("ERR", "300"))]}", ""
        failed += bool(res)
        print(f"{'FAIL' if res else 'ok  '} {name} {time.time() - t0:.1f}s{n} {res}", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main()
