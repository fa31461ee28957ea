"""Local oracle check: run each registered query on Spark and its SQL on
DuckDB over the same parquet tables; compare rows order-insensitively."""
import math
import sys
import time

import duckdb
import pandas as pd

from loanlens.plans.registry import oracle_sql, queries
from loanlens.session import get_spark
from loanlens.sources.fixture import TABLES


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        vals = []
        for v in row:
            if v is None or (isinstance(v, float) and math.isnan(v)):
                vals.append("<null>")
            elif isinstance(v, float):
                vals.append(round(v, 6) + 0.0)
            elif hasattr(v, "isoformat"):
                vals.append(str(pd.Timestamp(v).date()) if not hasattr(v, "hour") or (v.hour == 0 and v.minute == 0) else str(v))
            else:
                vals.append(str(v) if not isinstance(v, (int,)) else int(v))
        out.append(tuple(str(x) for x in vals))
    return sorted(out)


def main(sf_dir: str, names: list[str]) -> int:
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        if name not in sqls:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {time.time() - t:.1f}s")
            continue
        try:
            ddf = con.sql(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        cs, cd = sorted(sdf.columns), sorted(ddf.columns)
        if cs != cd:
            print(f"FAIL {name}: columns {cs} vs {cd}")
            bad += 1
            continue
        a, b = norm(sdf), norm(ddf)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}; first diffs {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(a)} rows {time.time() - t:.1f}s")
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(sf, sys.argv[2:]))
