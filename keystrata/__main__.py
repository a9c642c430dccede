"""``python -m keystrata ROOT [sorted|log]``: the line shell on a database, reading standard input; ``--seed FILE`` runs a seed file first."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from keystrata.engine import LOG, SORTED, Engine
from keystrata.frontend import run_seed, shell


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="keystrata")
    parser.add_argument("root")
    parser.add_argument("layout", nargs="?", choices=(LOG, SORTED), default=LOG)
    parser.add_argument("--seed")
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName("keystrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, told.root, told.layout)
    if told.seed:
        run_seed(engine, Path(told.seed).read_text())
    shell(engine, sys.stdin, print)


if __name__ == "__main__":
    main()
