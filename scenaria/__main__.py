"""Run named analyses: ``python -m scenaria <name|all> <tables_dir> [out_dir]``.

With ``out_dir`` each result is written as Parquet to ``out_dir/<name>``
(overwrite); otherwise all its rows are printed in report order, tab
separated. The session is the one that the launcher configures (master,
resources); without a launcher Spark's own default applies.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from scenaria.plans.catalog import ORDER, QUERIES, present
from scenaria.session import configure
from scenaria.sources.sinks import write_table


def session() -> SparkSession:
    """The launcher's session; no master is set here."""
    return configure(SparkSession.builder.appName("scenaria").getOrCreate())


def print_rows(df: DataFrame) -> None:
    """All rows, one partition at a time."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*row, sep="\t")


def main(argv: list[str]) -> int:
    if len(argv) < 2 or (argv[0] != "all" and argv[0] not in QUERIES):
        print(__doc__)
        print("analyses:", ", ".join(QUERIES))
        return 2
    name, tables = argv[0], argv[1]
    out = argv[2] if len(argv) > 2 else None
    spark = session()
    for n in QUERIES if name == "all" else [name]:
        df = QUERIES[n](spark, tables)
        if out:
            write_table(df, f"{out.rstrip('/')}/{n}", sort_within=ORDER.get(n, ()))
        else:
            print(f"== {n}")
            print_rows(present(df, n))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
