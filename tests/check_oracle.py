"""Run registered queries against SQL: python tests/check_oracle.py SF_DIR [name ...]"""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from loadlens.session import build_session  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                found = differences(df, con, sql[name])
                rows = f"rows {con.sql('SELECT count(*) FROM (' + sql[name] + ')').fetchall()[0][0]}"
            else:
                found, rows = [], f"rows-only {df.count()}"
        except Exception as err:  # report and go on
            found, rows = [f"{type(err).__name__}: {str(err)[:1500]}"], ""
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - started:.1f}s {rows} {found or ''}",
              flush=True)
    print("failures:", bad)


main()
