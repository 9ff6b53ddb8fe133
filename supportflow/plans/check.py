"""Compare registered queries with their DuckDB oracles (row count, columns, values).

    python -m supportflow.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

from supportflow.plans.oracle import oracle_sql
from supportflow.plans.queries import queries
from supportflow.sources.tables import DRIVER_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    out = {}
    for name in names or sorted(qs):
        rec = {"oracle": name in os_}
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
            rec["spark_sec"] = round(time.time() - t0, 2)
            rec["rows"] = len(s_rows)
            if name in os_:
                res = con.execute(os_[name])
                o_cols = [d[0] for d in res.description]
                o_rows = res.fetchall()
                rec["oracle_rows"] = len(o_rows)
                rec["cols_match"] = sorted(s_cols) == sorted(o_cols)
                rec["match"] = rec["cols_match"] and _rows(s_cols, s_rows) == _rows(o_cols, o_rows)
                if not rec["match"] and verbose:
                    rec["spark_cols"], rec["oracle_cols"] = sorted(s_cols), sorted(o_cols)
                    a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
                    rec["only_spark"] = [x for x in a if x not in b][:3]
                    rec["only_oracle"] = [x for x in b if x not in a][:3]
        except Exception as e:  # report and go on
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    from supportflow.session import ensure_checkpoint_dir, get_spark, ship_package
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(8)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("error") or (v.get("oracle") and not v.get("match"))]
    print("FAILED:", bad if bad else "none", f"({len(res)} queries)")
