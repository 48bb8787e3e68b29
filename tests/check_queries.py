"""Runs registered queries against their SQL: `python tests/check_queries.py [sf_dir] [name part]`."""

import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")
from paperloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, fn, sql):
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    names = sorted(types)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    if sql is None:
        return None, len(mine)
    rel = con.execute(sql)
    theirs_types = {d[0]: str(d[1]) for d in rel.description}
    rows = rel.fetchall()
    order = [list(theirs_types).index(n) for n in names] if sorted(theirs_types) == names else None
    if order is None:
        return f"columns {names} / {sorted(theirs_types)}", len(mine)
    theirs = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    if {n: types[n] for n in names} != {n: theirs_types[n] for n in names}:
        diff = {n: (types[n], theirs_types[n]) for n in names if types[n] != theirs_types[n]}
        return f"types {diff}", len(mine)
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"rows {len(mine)}/{len(theirs)} only mine {list(a)[:3]} only sql {list(b)[:3]} names {names}", len(mine)
    return None, len(mine)


def main():
    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    spark, con = local_session(), connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if part not in name:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s "
              f"{'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", bad)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
