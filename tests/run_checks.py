"""Compare all (or the named) queries with their SQL: python tests/run_checks.py sf_dir [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from flowspark.session import local_session  # noqa: E402
from tests.compare import database, differences  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), database(sf_dir)
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start, sql, n = time.time(), oracle_sql().get(name), 0
        try:
            df = run(spark, sf_dir)
            n = "" if sql else df.count()
            found = differences(df, con, sql) if sql else []
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {'' if sql else f'rows only {n}'}", flush=True)
        for line in found:
            print("     ", line[:900], flush=True)
    print("failed:", bad)
