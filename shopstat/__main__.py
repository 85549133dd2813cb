"""Command line.

    python -m shopstat build <data_dir> <out_dir>     write every table and mart, check keys
    python -m shopstat load <raw_dir> <lookup_file> <out_dir>   the same from the shop's own files
    python -m shopstat list                           list catalogue queries
    python -m shopstat show <query> <data_dir> [n]    print the first rows of a query
    python -m shopstat test <metric 1-5> <segment|source> <data_dir>   print a t-test report
    python -m shopstat chi2 <segment|source> <data_dir>                print a chi-square report

On a cluster, submit with spark-submit so the master and resources come from
there; the checkpoint folder is taken from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import sys

from shopstat.session import get_session


def main(argv: list[str]) -> int:
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    cmd, args = argv[0], argv[1:]
    from shopstat.plans.catalog import build_queries
    if cmd == "list":
        for name in build_queries():
            print(name)
        return 0
    spark = get_session()
    if cmd == "build":
        from shopstat.plans.batch import build_tables
        for name, path in build_tables(spark, args[0], args[1]).items():
            print(f"{name}\t{path}")
        return 0
    if cmd == "load":
        from shopstat.plans.batch import build_tables
        from shopstat.sources.shop import ShopFiles
        fmt = "parquet" if args[1].endswith(".parquet") else "csv"
        for name, path in build_tables(spark, ShopFiles(spark, args[0], args[1], fmt), args[2]).items():
            print(f"{name}\t{path}")
        return 0
    if cmd == "show":
        n = int(args[2]) if len(args) > 2 else 20
        build_queries()[args[0]](spark, args[1]).show(n, truncate=False)
        return 0
    if cmd in ("test", "chi2"):
        from shopstat.plans import metrics
        r = metrics.Roles(spark, args[-1])
        df = metrics.ttest(int(args[0]), args[1], r) if cmd == "test" else metrics.chi_square(args[0], r)
        row = df.first()
        print(row["report"] if row else "Error: both groups need rows.")
        return 0 if row else 1
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
