"""python -m textmill QUERY TABLES [OUT]: run a registered query over a folder of Parquet tables; print it or write it to OUT."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from textmill.plans import catalogue, dedup_queries, metric_queries, more_queries, text_queries, web_queries  # noqa: F401

    if len(args) < 2 or args[0] not in catalogue.QUERIES:
        print(__doc__, "Queries: " + ", ".join(sorted(catalogue.QUERIES)), sep="\n", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from textmill.operators.counts import markdown

    spark = SparkSession.builder.getOrCreate()
    df = catalogue.QUERIES[args[0]](spark, args[1])
    if len(args) > 2:
        df.write.mode("errorifexists").parquet(args[2])
    else:
        print(markdown(df.limit(50)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
