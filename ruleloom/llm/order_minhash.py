"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are its runs of ``k`` words; equal k-mers are numbered by
occurrence, so that (k-mer, occurrence) pairs are distinct.  A hash deals the
pairs into ``slots`` groups (one permutation serves all of them); in each slot
the ``pick`` pairs of least hash are selected, put back into text order, and
their k-mers hashed together.  Two texts agree in a slot if they share the
selected pairs *in the same order*: the likeness, the share of agreeing slots
among those that either text fills, falls with edit distance, not only with
the overlap of sets.

In a short text a slot is dealt fewer than ``pick`` pairs, and one pair alone
holds no order.  With ``fill`` each slot ranks all pairs of the text, those
dealt to it first and then the others by a hash of the slot's own, and selects
the least ``pick``.  Such an order is as random as any, so every slot is a full
Order MinHash selection from the whole text, and texts of any length compare.

Everything happens inside a row, on arrays of longs: a k-mer's hash and its
position share one long, so that sorting, numbering, dealing and selecting are
sorts and scans of primitive arrays, linear (times a logarithm) in the text.
Occurrence numbers of repeated k-mers come from a running maximum by doubling.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low bits for a position, more than a text of 2 GB has words; the rest of a (positive) long is hash.
POSITION_BITS = 30
HASH_BITS = 63 - POSITION_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where lambdas use it.

    A column that only one lambda names is inlined by the optimizer and then
    computed for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - HASH_BITS), POSITION_BITS).bitwiseOR(position.cast("bigint"))


def _hash_part(value: Column) -> Column:
    return F.shiftright(value, POSITION_BITS)


def _position(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("bigint"))


def with_order_minhash(df: DataFrame, text: str, out: str, k: int = 5, slots: int = 64, pick: int = 2, fill: bool = False) -> DataFrame:
    """``df`` with a column ``out``: an array of ``slots`` ints, null where a slot is empty.

    A null text counts as empty; an empty text has only empty slots.  Texts of
    fewer than ``k`` words, and the last words of any text, give shorter
    k-mers.  Equal texts have equal fingerprints.  With ``fill`` only an empty
    text has empty slots, and only a text of fewer than ``pick`` words has
    slots with fewer than ``pick`` pairs.
    """
    c = lambda name: f"__{out}_{name}"
    keep = df.columns
    words = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = df.withColumn(c("w"), words)
    w = F.col(c("w"))
    # (hash of k-mer, position), sorted: equal k-mers stand together in text order
    d = d.withColumn(c("s"), F.sort_array(F.transform(w, lambda x, i: _packed(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]), i))))
    s = F.col(c("s"))
    again = lambda v, i: (i > 0) & (_hash_part(F.get(s, i - 1)) == _hash_part(v))
    # the first has none before it: null, which a filter takes for false
    d = d.withColumn(c("r"), F.filter(s, lambda v, i: F.get(s, i - 1).bitwiseXOR(v) < (1 << POSITION_BITS)))
    r = F.col(c("r"))
    d = d.withColumn(c("f"), F.when(F.size(r) == 0, s).otherwise(F.filter(s, lambda v, i: ~again(v, i))))
    f = F.col(c("f"))
    # start of each run of repeats: running maximum of the indices that begin one
    begins = F.transform(r, lambda v, i: F.when((i > 0) & (_hash_part(F.get(r, i - 1)) == _hash_part(v)), F.lit(0)).otherwise(i))
    steps = F.when(F.size(r) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(r).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = F.aggregate(steps, begins, lambda acc, t: F.transform(acc, lambda v, i: F.greatest(v, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), t)), F.lit(0)))))
    numbers = F.transform(runs, lambda v, i: i - v + 2)
    number = lambda v, n: _packed(F.xxhash64(_hash_part(v), n), _position(v))
    # numbered pairs, dealt into slots: the slot is the top of the new hash
    # both arrays have the same length, but only what can't be null is sorted as plain longs
    repeated = F.zip_with(r, numbers, lambda v, n: F.coalesce(number(v, n), F.lit(0).cast("bigint")))
    d = d.withColumn(c("p"), F.sort_array(F.concat(F.transform(f, lambda v: number(v, F.lit(1))), repeated)))
    p = F.col(c("p"))
    slot = lambda v: F.shiftrightunsigned(F.shiftleft(v, 1), 32) * F.lit(slots).cast("bigint")
    slot_of = lambda v: F.shiftrightunsigned(slot(v), 32).cast("int")
    least = F.filter(p, lambda v, i: (i < pick) | (slot_of(F.get(p, i - pick)) != slot_of(v)))
    d = d.withColumn(c("l"), least)
    chosen = F.col(c("l"))
    at = lambda i, v: F.shiftleft(i.cast("bigint"), 40).bitwiseOR(_position(v))
    placed = F.transform(chosen, lambda v: at(slot_of(v), v))
    if fill:
        # slots that were dealt fewer than pick pairs, with their number of pairs; a slot's pairs stand together
        full = F.transform(F.filter(chosen, lambda v, i: (i >= pick - 1) & (slot_of(F.get(chosen, i - (pick - 1))) == slot_of(v))), slot_of)
        short = F.array_except(F.sequence(F.lit(0), F.lit(slots - 1)), full)
        d = d.withColumn(c("n"), F.transform(short, lambda i: F.struct(i.alias("i"), F.size(F.filter(chosen, lambda v: slot_of(v) == i)).alias("n"))))
        own = lambda e: F.transform(F.filter(p, lambda v: slot_of(v) != e["i"]), lambda v: _packed(F.xxhash64(_hash_part(v), e["i"]), _position(v)))
        # mostly one pair is missing: the least needs no sort
        one = lambda x: F.filter(F.array(F.array_min(x)), lambda v: v.isNotNull())
        some = lambda e: let(own(e), lambda x: F.when(e["n"] == pick - 1, one(x)).otherwise(F.slice(F.sort_array(x), F.lit(1), F.lit(pick) - e["n"])))
        others = lambda e: F.transform(some(e), lambda v: at(e["i"], v))
        placed = F.concat(placed, F.flatten(F.transform(F.col(c("n")), others)))
    # in text order within each slot: (slot, position, index of the word)
    ordered = F.sort_array(placed)
    d = d.withColumn(c("o"), ordered)
    o = F.col(c("o"))
    kmer = lambda v: F.xxhash64(*[F.get(w, _position(v).cast("int") + j) for j in range(k)])
    of = lambda v: F.shiftright(v, 40).cast("int")
    ends = lambda v, i: F.coalesce(of(F.get(o, i + 1)) != of(v), F.lit(True))
    pair = lambda v, i: F.struct(of(v).alias("slot"), F.when(ends(v, i), F.xxhash64(*[F.when((i >= back) & (of(F.get(o, i - back)) == of(v)), kmer(F.get(o, i - back))) for back in range(pick - 1, -1, -1)])).alias("h"))
    filled = F.filter(F.transform(o, pair), lambda e: e["h"].isNotNull())
    part = lambda h: F.shiftright(h, 32).cast("int")
    found = lambda m: F.transform(F.array(*[F.lit(i) for i in range(slots)]), lambda i: part(F.try_element_at(m, i)))
    # entries are in the order of slots: where none is empty they need no look-up
    sketch = let(filled, lambda e: F.when(F.size(e) == slots, F.transform(e, lambda x: part(x["h"]))).otherwise(let(F.map_from_entries(e), found)))
    return d.withColumn(out, sketch).select(*[F.col(f"`{x}`") for x in keep], out)


def as_text(sketch: Column) -> Column:
    """Eight lower-case hexadecimal digits a slot; dots for an empty one."""
    return F.array_join(F.transform(sketch, lambda v: F.coalesce(F.lower(F.lpad(F.hex(v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0")), F.lit("........"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing slots among those that either text fills; 1 for two empty texts."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(0)).when(x.eqNullSafe(y), F.lit(0x10001)).otherwise(F.lit(1)))
    total = F.aggregate(both, F.lit(0), lambda s, v: s + v)
    share = let(total, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.shiftright(n, 16) / n.bitwiseAND(F.lit(0xFFFF))))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(share)


def _range_bucket(key: Column, cuts: Column, size: int) -> Column:
    """Number of cuts at or below the key, by binary search."""
    steps, at = [], 1
    while at <= size:
        steps.insert(0, at)
        at *= 2
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda low, step: F.when(F.coalesce(F.get(cuts, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low))


def with_next(df: DataFrame, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, rows_a_bucket: int = 128, most_buckets: int = 16_384) -> DataFrame:
    """``prepare(df)`` with a struct ``next`` of its columns in the next row by descending key.

    The last row's next is the first.  Null keys come last; rows that repeat a
    key follow each other in the order of a hash.  The order is global but no
    task sees more than a bucket: keys are cut at approximate quantiles, a key
    that holds several of them gets a bucket of its own, and such a bucket, like
    that of null keys, is cut by the hash.  The head of each bucket joins the
    bucket before it as a guest, and rows look ahead within their bucket.  The
    rows are exchanged once.  At most ``most_buckets`` quantiles reach the
    driver; with more rows than that buckets hold more of them, sorted on disk.
    """
    df = df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    n, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    size = max(1, min(most_buckets, n // rows_a_bucket))
    quantiles = (df.agg(F.percentile_approx(key, F.expr(f"array({','.join(f'{i / size}D' for i in range(1, size))})"), F.lit(10 * size))).first()[0] or []) if size > 1 else []
    # a key that is more than one quantile holds more than a bucket's rows
    held = {q: c + 1 for q, c in Counter(quantiles).items() if c > 1}
    cuts = sorted({*quantiles, *held, *(q + 1 for q in held)})
    pieces = F.lit(1)
    if held:
        pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast(t) for q, c in held.items() for x, t in ((q, "bigint"), (c, "int"))]), F.col(key)), F.lit(1))
    pieces = F.when(F.col(key).isNull(), F.lit(max(1, -(-nulls * size // max(1, n))))).otherwise(pieces)
    piece = F.floor(F.shiftrightunsigned("__h", 32) * pieces / float(1 << 32)).cast("int")
    at = F.expr(f"array({','.join(f'{c}L' for c in cuts)})") if cuts else None
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(_range_bucket(F.col(key), at, len(cuts)) if cuts else F.lit(0))
    # buckets in the order of rows: keys descend, hashes ascend
    d = df.withColumn("__bucket", F.struct((-bucket).alias("b"), piece.alias("p")))
    # one row a bucket
    first = F.min(F.struct((-F.col(key)).alias("k"), F.col("__h").alias("h")))
    heads = d.groupBy("__bucket").agg(first.alias("f"))
    order = Window.orderBy("__bucket")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select((-F.col("f.k")).alias("__head"), F.col("f.h").alias("__first"), F.coalesce(F.lag("__bucket").over(order), F.last("__bucket").over(around)).alias("__host"))
    guests = df.join(F.broadcast(heads), df[key].eqNullSafe(F.col("__head")) & (F.col("__h") == F.col("__first"))).drop("__head", "__first").withColumnRenamed("__host", "__bucket")
    both = d.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))
    both = prepare(both)
    columns = [c for c in both.columns if c not in ("__bucket", "__guest", "__h")]
    w = Window.partitionBy("__bucket").orderBy("__guest", F.col(key).desc_nulls_last(), "__h")
    return both.withColumn("next", F.lead(F.struct(*[F.col(c) for c in columns])).over(w)).where("__guest = 0").drop("__bucket", "__guest", "__h")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, slots: int = 64, pick: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last third of code points (rounded down) replaced
    by as many of the first ones (or all) of the next document by descending
    key; the last document's next is the first.  Returns ``(key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    Null texts count as empty; a single document is its own next.  Null keys
    come last, rows that repeat a key in the order of a hash.  Texts of any
    length are read whole.  Repeated rows are kept, an empty table gives an
    empty result, and other columns are ignored.
    """
    d = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = with_next(d, "k", lambda x: with_order_minhash(x, "t", "sketch", k, slots, pick, fill=True))
    n = F.char_length("t")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - cut), F.substring(F.col("next.t"), F.lit(1), cut))
    d = d.select("k", n.cast("bigint").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    d = with_order_minhash(d, "edited", "edited_sketch", k, slots, pick, fill=True)
    return d.select(
        F.col("k").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
