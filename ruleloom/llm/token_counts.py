"""Exact token-length histogram.

Documents are encoded and counted by length: every task keeps one small
histogram and only (length, documents) pairs are exchanged.  Suffix sums over
the histogram then answer, for every context limit, how many documents fit,
how many tokens they have, what truncation at the limit keeps, and which
quantile the limit is.  The sums run in two levels (blocks of lengths, then
lengths of a block), so no single task sees all lengths.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import materialize

#: Lengths in one block of the suffix sums.
BLOCK = 64

_encoders: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str | None = None):
    """A byte-level encoder from a file of ranks; one for each process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def length_histogram(docs: DataFrame, text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``(n_tokens, n_docs)``: documents by encoded length.

    Null and empty texts have length 0.  Repeated rows count each time.  An
    empty table gives an empty histogram; other columns are ignored.
    """
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen = encoder(path).encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(t)) if t else 0 for t in batch["t"])
        yield pd.DataFrame({"n_tokens": list(seen), "n_docs": list(seen.values())}, dtype="int64")

    part = docs.select(F.col(f"`{text}`").alias("t")).mapInPandas(run, "n_tokens bigint, n_docs bigint")
    # one small row a length: written, so that no later step encodes texts again
    return materialize(part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def every_limit(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    ``docs_within`` and ``tokens_within`` count documents of at most that
    length, ``docs_over`` and ``tokens_over`` longer ones, ``truncated_total``
    the tokens left when all documents are cut at the limit, and ``quantile``
    the share of documents within.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    h = h.join(blocks, "block")
    over, tokens_over = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return h.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - over).alias("docs_within"),
        (F.col("all_tokens") - tokens_over).alias("tokens_within"),
        over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("all_tokens") - tokens_over + over * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, docs_within, docs_over, truncated_total)`` for any limits, also between lengths."""
    one = [F.struct(F.lit(int(x)).cast("bigint").alias("context_limit"), F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs")).otherwise(0)).alias("docs_within"), F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias("truncated_total")) for x in limits]
    return histogram.agg(F.array(*one).alias("x")).select(F.inline("x"))


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the least length that at least that share of documents doesn't exceed."""
    q = every_limit(histogram)
    return q.agg(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]).alias("x")).select(F.inline("x"))
