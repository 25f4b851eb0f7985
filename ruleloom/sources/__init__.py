"""Tables by name, path or SQL, and written tables that cut lineage."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ruleloom.lang.ast import ProgramError

#: File suffixes and Spark's readers.
READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}


def read_path(spark: SparkSession, path: str) -> DataFrame:
    for suffix, kind in READERS.items():
        if path.rstrip("/").endswith(suffix):
            reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
            return reader.format(kind).load(path)
    raise ProgramError(f"no reader for {path!r}")


def resolve(spark: SparkSession, name: str, tables: dict) -> DataFrame | None:
    """A table that no rule defines: given by the caller, a query or file in parentheses, or from the catalog."""
    found = tables.get(name)
    if found is not None:
        return read_path(spark, found) if isinstance(found, str) else found
    if name.startswith("("):
        inner = name[1:-1].strip()
        if inner[:1] in "\"'":
            return read_path(spark, inner.strip("\"'"))
        return spark.sql(inner[1:-1] if inner.startswith("(") else inner)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return None


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export by suffix."""
    for suffix, kind in READERS.items():
        if path.endswith(suffix):
            (df.write.option("header", True) if kind == "csv" else df.write).format(kind).mode(mode).save(path)
            return
    raise ProgramError(f"no writer for {path!r}")


def read_text(spark: SparkSession, path: str) -> str:
    """A whole text file, by any path that Spark can read; for constants of a program."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""


def _shown(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, dict, Row)):
        return json.dumps(value.asDict(True) if isinstance(value, Row) else value, default=lambda v: v.asDict(True) if isinstance(v, Row) else str(v), ensure_ascii=False)
    return str(value)


def text_table(df: DataFrame, rows: int | None = None) -> str:
    """A bordered text table of all rows, or of the first ``rows``; numbers stand on the right."""
    head = df.columns
    found = [[v.asDict(True) if isinstance(v, Row) else [x.asDict(True) if isinstance(x, Row) else x for x in v] if isinstance(v, list) else v for v in r] for r in (df if rows is None else df.limit(rows)).collect()]
    body = [[_shown(v) for v in r] for r in found]
    wide = [max(len(x) for x in column) for column in zip(head, *body, strict=True)]
    number = [not isinstance(v, str) and all(isinstance(x, (int, float, type(None))) and not isinstance(x, bool) for x in column) for v, *column in zip([0] * len(head), *found, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    top = "|" + "|".join(f" {x:^{w}} " for x, w in zip(head, wide, strict=True)) + "|"
    form = lambda r: "|" + "|".join(f" {x:>{w}} " if n else f" {x:<{w}} " for x, w, n in zip(r, wide, number, strict=True)) + "|"
    return "\n".join([line, top, line, *map(form, body), line])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master that has none, a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ProgramError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ruleloom-"))
    return context.getCheckpointDir().get()


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates over the rows taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return out, seen.get


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: one computation, no lineage."""
    path = f"{shared_dir(df.sparkSession)}/rules-{uuid.uuid4().hex}"
    df = df.select(*[F.col(f"`{c}`").cast("string") if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    path = getattr(df, "_stored_at", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
