"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words.  The whole part of its target over
its size is allocated with certainty: every document is taken so often.  For
the rest, documents are ranked by Pareto order: random odds u / (1 - u) over
inclusion odds.  Inclusion odds differ by document: they are those of the
source's remaining share, times the document's words over the source's mean, so
long documents are likelier to be taken once more.  The sample is the first part of that ranking
whose words come nearest to the source's remaining target: its size, in words,
is fixed instead of random.  The random numbers are a hash of key and text, so
reruns agree, and SQL can repeat them.

The ranking is never sorted.  Ranks are integers of 52 bits, and the rank at
which a source's sample ends is found by radix selection: sums of words by the
first 13 bits, then by the next 13 within the one bin where the sample ends, and
so on.  Only sums are exchanged; a document is then taken if its rank is at or
below its source's cut, without a shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import WORD, discard, materialize

#: Bits of a rank, and of a level of the selection.
RANK_BITS, LEVEL_BITS = 52, 13
#: Largest table of sources that is broadcast.
FEW_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` times all words by weight.  No target exceeds ``most`` times its
    source; the excess goes to the others by weight.  That is a water level:
    with sources ordered by room per weight, the first ones are full, and the
    level of the rest is what remains over the weights that remain.  One row a
    source: the only single-partition step, over a table of sources.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(x) for x in weights])
    s = sizes.withColumn("weight", F.get(w, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("double"))
    s = s.withColumn("room", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    goal = F.lit(float(share) * float(total))
    s = s.withColumn("level", (goal - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("fits", (F.col("level") * F.col("weight") <= F.col("room")).cast("int"))
    # the level of the first source that is not full holds for all after it
    s = s.withColumn("first_level", F.first(F.when(F.col("fits") == 1, F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("is_open", F.max("fits").over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("is_open") == 1, F.least(F.col("room"), F.col("first_level") * F.col("weight"))).otherwise(F.col("room"))
    return s.select("source", "source_size", target.alias("target"))


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of key and text; keys that repeat or lack share none."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << RANK_BITS)


def _by_source(rows: DataFrame, sources: DataFrame, few: bool, also: Column | None = None) -> DataFrame:
    """Rows with the columns of their source's line; null is a source too."""
    on = F.col("source").eqNullSafe(F.col("of_source"))
    return rows.join(F.broadcast(sources) if few else sources, on if also is None else on & also).drop("of_source")


def _rank(size: Column, u: Column) -> Column:
    """Pareto rank; null where the source's share is whole."""
    p, mean = F.col("p"), F.col("source_size") / F.col("rows")
    ratio = (u / (1 - u)) / ((p / (1 - p)) * (F.greatest(size, F.lit(1)) / mean))
    return F.when(p > 0, F.floor(ratio / (1 + ratio) * float(1 << RANK_BITS)).cast("bigint"))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, bool]:
    """One line a source, written, and whether these are few.

    ``sizes`` has the columns source, size and u.  A line has ``of_source``,
    ``source_size``, ``rows``, ``target``, ``whole`` (certain copies), ``p``
    (the remaining share) and ``cut``, the last rank that is taken.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "totals")
    t = source_targets(totals.select("source", "source_size"), weights, share, most)
    t = t.join(totals.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.floor(rate).cast("bigint")).withColumn("p", rate - F.col("whole"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of_source")
    t = materialize(t, "targets")
    few = t.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    ranked = _by_source(sizes, t.where("p > 0"), few).select("source", "size", _rank(F.col("size"), F.col("u")).alias("rank"), "rest")
    # the bits found so far, and the words before them
    found = t.where("p > 0").select("of_source", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("cut"))
    for shift in range(RANK_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        found = _level(ranked, found, few, shift)
    plan = materialize(t.join(found.select(F.col("of_source").alias("s4"), "cut"), F.col("of_source").eqNullSafe(F.col("s4")), "left").drop("s4", "rest"), "plan")
    for done in (totals, t, found):
        discard(done)
    return plan, few


def _level(ranked: DataFrame, found: DataFrame, few: bool, shift: int) -> DataFrame:
    """Selection goes on by the next bits of the rank, within the bin where each source's sample ends."""
    bins = 1 << LEVEL_BITS
    inside = _by_source(ranked, found.where("cut is null"), few, F.shiftright("rank", shift + LEVEL_BITS) == F.col("prefix"))
    digit = F.shiftright("rank", shift).bitwiseAND(F.lit(bins - 1).cast("bigint")).alias("digit")
    sums = inside.groupBy("source", "prefix", "before", "rest", digit).agg(F.sum("size").alias("here"))
    w = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.col("before") + F.sum("here").over(w))
    whole = (F.col("prefix") + 1) * (bins << shift) - 1
    if shift:  # the sample ends in the first bin that goes beyond the rest
        ends = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", (F.col("upto") - F.col("here")).alias("before")))).alias("end")
        after = sums.groupBy("source", "prefix", "before").agg(ends)
        after = after.select(F.col("source").alias("of_source"), F.when(F.col("end").isNull(), F.col("prefix")).otherwise(F.col("prefix") * bins + F.col("end.digit")).alias("prefix"), F.coalesce("end.before", "before").alias("before"), F.when(F.col("end").isNull(), whole).alias("cut"))
    else:  # the rank that crosses the target is taken if that comes nearer to it
        last = F.max(F.when(F.col("upto") - F.col("here") / 2.0 <= F.col("rest"), F.col("digit"))).alias("last")
        after = sums.groupBy("source", "prefix", "before").agg(last)
        after = after.select(F.col("source").alias("of_source"), "prefix", "before", (F.col("prefix") * bins + F.coalesce("last", F.lit(-1))).alias("cut"))
    out = materialize(after.unionByName(found.where("cut is not null")), "found")
    discard(found)
    return out


def with_copies(rows: DataFrame, plan: DataFrame, few: bool, size: Column, u: Column) -> DataFrame:
    """``rows`` (with a column source) and ``size``, ``source_size``, ``target``, ``copies`` of each."""
    keep = rows.columns
    d = _by_source(rows.withColumn("size", size).withColumn("__u", u), plan, few)
    chosen = F.coalesce(_rank(F.col("size"), F.col("__u")) <= F.col("cut"), F.lit(False)).cast("bigint")
    return d.select(*keep, *[c for c in ("size", "source_size", "target") if c not in keep], (F.col("whole") + chosen).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)`` for every document.

    ``copies`` is how often the mix takes the document, ``taken`` its words so
    taken.  A null text has size 0, a null source is a source of its own.
    Sources without words have target 0.  Rows that repeat both key and text
    have one rank and are taken together; so are other rows of equal rank.
    Null keys, and keys that repeat with other texts, are ranked each on their
    own.  Texts of any length are counted whole.  An empty table gives an empty
    result; other columns are ignored.
    """
    t = F.col("t")
    d = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("t"))
    d = materialize(d.select("k", "source", words(t).alias("size"), uniform(F.col("k"), t).alias("u")), "sizes")  # texts are read once
    plan, few = source_plan(d, weights, share, most)
    out = with_copies(d, plan, few, F.col("size"), F.col("u"))
    return out.select(F.col("k").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, without a shuffle of rows."""
    t, u = words(F.col(f"`{text}`")), uniform(F.col(f"`{key}`"), F.col(f"`{text}`"))
    sizes = materialize(docs.select(F.col(f"`{source}`").alias("source"), t.alias("size"), u.alias("u")), "sizes")
    plan, few = source_plan(sizes, weights, share, most)
    discard(sizes)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("source"), t.alias("__size"), u.alias("u"))
    taken = with_copies(rows, plan, few, F.col("__size"), F.col("u")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).select("row.*")
