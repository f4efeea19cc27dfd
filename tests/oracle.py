"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_CLASS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}

# Nothing may leave the JVM or pair up rows without a key.
NOT_IN_PLANS = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow")


def connect(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def compare(spark, con, directory, query, sql):
    """Return a list of differences; empty when schema and rows agree."""
    df = query(spark, directory)
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = [f"plan has {bad}" for bad in NOT_IN_PLANS if bad in plan]
    cols = sorted(df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"]
    for f in df.schema.fields:
        want = _CLASS.get(f.dataType.simpleString())
        if want != types[f.name]:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    idx = [names.index(c) for c in cols]
    theirs = sorted(([_norm(r[i]) for i in idx] for r in res.fetchall()), key=_key)
    ours = sorted(([_norm(r[c]) for c in cols] for r in df.collect()), key=_key)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {dict(zip(cols, zip(*bad[0])))}")
    return out
