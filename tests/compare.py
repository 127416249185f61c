"""Run registered queries on Spark and their SQL on DuckDB, compare whole results.

    python tests/compare.py [--sf sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


KIND = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int", "double": "float",
        "float": "float", "real": "float", "string": "str", "varchar": "str", "boolean": "bool", "date": "date",
        "timestamp": "ts", "timestamp_ntz": "ts"}


def key_of(row):
    return tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v) for v in row)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(spark_df.columns)
    kinds = {c: KIND.get(t, t) for c, t in spark_df.dtypes}
    got = [tuple(norm(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    desc = [(d[0], str(d[1]).lower()) for d in cur.description]
    names = [d[0] for d in desc]
    if sorted(names) != cols:
        return False, f"columns differ: spark {cols} duck {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    note = ""
    for c in cols:
        dk = KIND.get(desc[names.index(c)][1], desc[names.index(c)][1])
        if dk != kinds[c]:
            note += f" type {c}: spark {kinds[c]} duck {dk};"
    if len(got) != len(want):
        return False, f"rows differ: spark {len(got)} duck {len(want)};{note}"
    try:
        got.sort(key=key_of)
        want.sort(key=key_of)
    except TypeError as exc:
        return False, f"unsortable {exc};{note}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, cols {cols}, first {bad[0]};{note}"
    if "type" in note and any(k in note for k in ("hugeint", "decimal")):
        return False, f"rows ok {len(got)};{note}"
    return True, f"{len(got)} rows;{note}"


def main(argv: list[str]) -> int:
    sf = "sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/{sf}"
    import __spark_entry__ as entry

    from equityspark.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                ok, msg = compare(df, con, oracle[name])
            else:
                ok, msg = True, f"{df.count()} rows (no SQL)"
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
