"""Rules over streams.

Rules without aggregation, negation or recursion are stateless: a predicate
over a streaming table is a streaming DataFrame as it stands, by
``Program(text, spark, tables={"events": spark.readStream...})``.  Aggregation
over event time goes through ``windowed``, which bounds its state by a
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.lang.ast import ProgramError


def windowed(stream: DataFrame, time: str, every: str, late: str, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """``stream`` with ``window_start`` and ``window_end`` under a watermark of ``late``.

    Tumbling windows of ``every``, sliding ones with ``slide``, sessions with
    ``gap``.  Rules then group by the window like by any field.
    """
    marked = stream.withWatermark(time, late)
    if gap is not None:
        raise ProgramError("session windows close over groups: use session_counts")
    w = F.window(time, every, slide) if slide else F.window(time, every)
    return marked.withColumn("window", w)


def window_aggregates(stream: DataFrame, time: str, every: str, late: str, keys: list[str], aggregates: dict[str, str], slide: str | None = None) -> DataFrame:
    """Aggregates (name to Spark SQL) by window and keys, with bounded state."""
    w = windowed(stream, time, every, late, slide)
    out = w.groupBy("window", *keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def session_counts(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Events for each session and key; a session ends after ``gap`` without events."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "events")
