"""Run registered queries against their SQL and compare values, order-insensitively."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from contextlib import contextmanager

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def records_read(spark) -> int:
    """Input records of all stages so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def sort_key(row):
    # Exact values first; floats only roughly, so noise in the last digits cannot reorder rows.
    return tuple(("~", f"{v:.6g}") if isinstance(v, float) else (str(type(v)), str(v)) for v in row)


def differences(spark_rows, sql_rows, tolerance: float = 1e-9, absolute: float = 1e-9) -> list[str]:
    """Descriptions of the first mismatches; both sides are lists of tuples with columns in the same order."""
    if len(spark_rows) != len(sql_rows):
        return [f"rows {len(spark_rows)} != {len(sql_rows)}"]
    exact = lambda r: tuple(str(v) for v in r if not isinstance(v, float))
    a = sorted(([plain(v) for v in r] for r in spark_rows), key=lambda r: (exact(r), sort_key(r)))
    b = sorted(([plain(v) for v in r] for r in sql_rows), key=lambda r: (exact(r), sort_key(r)))
    out = []
    for x, y in zip(a, b, strict=True):
        for u, w in zip(x, y, strict=True):
            both = isinstance(u, (int, float)) and isinstance(w, (int, float)) and not isinstance(u, bool)
            if both and (isinstance(u, float) or isinstance(w, float)):
                same = math.isclose(u, w, rel_tol=tolerance, abs_tol=absolute)
            else:
                same = u == w and type(u) is type(w)
            if not same:
                out.append(f"{x} != {y}")
                break
        if len(out) == 3:
            break
    return out


def check(spark, con, sf_dir: str, name: str, build, sql: str | None, tolerance: float = 1e-9, absolute: float = 1e-9):
    began = time.time()
    df = build(spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    took = time.time() - began
    if sql is None:
        return len(rows), took, [], "rows only"
    cur = con.execute(sql)
    order = [d[0] for d in cur.description]
    if sorted(order) != names:
        return len(rows), took, [f"columns {names} != {sorted(order)}"], "sql"
    pick = [order.index(n) for n in names]
    want = [tuple(r[i] for i in pick) for r in cur.fetchall()]
    kinds = {n: (str(df.schema[n].dataType.simpleString()), str(cur.description[order.index(n)][1])) for n in names}
    return len(rows), took, differences(rows, want, tolerance, absolute), kinds


def main() -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from edaflux.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            n, took, diff, kinds = check(spark, con, sf_dir, name, build, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        bad += bool(diff)
        note = "" if isinstance(kinds, str) else " ".join(f"{k}:{a}/{b}" for k, (a, b) in kinds.items() if mismatch(a, b))
        print(f"{'DIFF' if diff else 'ok  '} {name} rows={n} {took:.2f}s {'' if sqls.get(name) else '(rows only)'} {note}", flush=True)
        for d in diff:
            print("     ", d[:600])
    print("bad:", bad)
    return bad


_SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def mismatch(spark_kind: str, sql_kind: str) -> bool:
    return _SAME.get(spark_kind) != sql_kind.upper()


if __name__ == "__main__":
    sys.exit(main())
