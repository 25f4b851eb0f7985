"""``python -m ruleloom FILE run|csv|explain|schema PREDICATE [OUT] [--flag=value ...] [--table=name:path ...]``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from ruleloom import Program


def main(args: list[str]) -> int:
    named = [a[2:].partition("=") for a in args if a.startswith("--")]
    plain = [a for a in args if not a.startswith("--")]
    if len(plain) < 3 or plain[1] not in ("run", "csv", "explain", "schema"):
        print(__doc__)
        return 2
    file, command, name, *out = plain
    tables = dict(v.split(":", 1) for k, _, v in named if k == "table")
    flags = {k: v for k, _, v in named if k != "table"}
    with sys.stdin if file == "-" else open(file, encoding="utf-8") as f:
        text = f.read()
    spark = SparkSession.builder.getOrCreate()
    program = Program(text, spark, tables, flags, roots=[".", *os.environ.get("RULELOOM_PATH", "").split(":")])
    if command == "csv":
        program.csv(name, out[0] if out else f"{name}.csv")
    else:
        print({"run": program.text, "explain": program.explain, "schema": lambda n: program.df(n).schema.treeString()}[command](name))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
