"""Run registered queries next to their SQL in DuckDB and compare whole results.

Command line: python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _row(values):
    return tuple("~" if v is None else (repr(float(v)) if isinstance(v, float) else str(v)) for v in values)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first differences."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(_row([r[i] for i in order]) for r in cur.fetchall())
    got = sorted(_row(r) for r in df.select(*cols).collect())
    if want == got:
        return None
    miss = [r for r in want if r not in set(got)][:3]
    extra = [r for r in got if r not in set(want)][:3]
    return f"rows spark={len(got)} sql={len(want)}\n  cols {cols}\n  sql only {miss}\n  spark only {extra}"


def main(argv):
    import __spark_entry__ as entry
    from tidepanel.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("oracle", "local[8]", 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = compare(df, con, oracles[name]), ""
            else:
                problem, n = None, f" rows-only {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:400]}", ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t:.1f}s{n}", flush=True)
        if problem:
            bad.append(name)
            print("  " + problem, flush=True)
    print(f"{len(bad)} failing: {' '.join(bad)}")


if __name__ == "__main__":
    main(sys.argv[1:])
