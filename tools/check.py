"""Run registered queries against their SQL: tools/check.py SF_DIR [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))

from oracle import compare, connect

from unitcal.plans.catalog import CATALOG
from unitcal.session import build_session


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, entry in CATALOG.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = entry.run(spark, sf)
            if entry.sql is None:
                problem = None
                note = f"{len(df.collect())} rows, no SQL"
            else:
                problem = compare(df, con, entry.sql)
                note = "ok"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
