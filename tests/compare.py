"""Run registered queries beside their check SQL: ``python -m tests.compare sf_dir [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(columns, rows):
    """Rows with columns in name order and values in a common form, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            number = round(float(v), 6)
            return str(int(number)) if number == int(number) else repr(number)
        return str(v)

    return sorted(columns), sorted(tuple(value(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from urlrisk.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    run, oracles, bad = queries(), oracle_sql(), []
    for name in names or run:
        start = time.time()
        try:
            got = spark_rows(run[name](spark, sf_dir))
            spent = time.time() - start
            if name not in oracles:
                print(f"{name}: {len(got[1])} rows, no oracle, {spent:.1f}s", got[1][:2] if names else "", flush=True)
                continue
            start = time.time()
            want = oracle_rows(con, oracles[name])
            same = got == want
            print(f"{name}: {'ok' if same else 'MISMATCH'} {len(got[1])}/{len(want[1])} rows, "
                  f"{spent:.1f}s spark, {time.time() - start:.1f}s sql", flush=True)
            if not same:
                bad.append(name)
                print("   columns", got[0], want[0])
                only, other = [r for r in got[1] if r not in set(want[1])], [r for r in want[1] if r not in set(got[1])]
                for a in only[:4]:
                    print("   spark", a)
                for b in other[:4]:
                    print("   sql  ", b)
        except Exception as problem:
            bad.append(name)
            print(f"{name}: ERROR {str(problem).splitlines()[0][:400]}", flush=True)
            if names:
                print(traceback.format_exc(limit=-4)[:1500])
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
