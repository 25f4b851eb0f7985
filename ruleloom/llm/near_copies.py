"""Near copies by SimHash with deletion variants, held to the exact likeness of shingle sets.

A text's shingles are its runs of ``width`` lower-cased words, hashed; equal
sets are one node, and a node's fingerprint is the SimHash of its set.  The
operator of ``simhash`` links fingerprints within ``DISTANCE`` bits through
their one-wildcard segment keys; what it connects is a cell, and within a cell
the sets themselves are compared, every one with every other, so every link
holds exactly.

Four bits don't reach all pairs at a likeness of 0.8: about ten differ there.
For the rest sets are also indexed under ``BANDS`` keys of ``ROWS`` least values
each: a pair at likeness 0.8 misses all keys with a chance of (1 - 0.8^4)^24,
about 3 in a million, and less above.  A key whose members lie in one cell has
nothing to add; under the others the sets are compared in the same way.

Cells and keys with the same members are looked at once; a walk over the
members keeps a spanning forest of the links, and those with more than
``chunk`` members are cut into chunks, each pair of chunks a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import simhash
from ruleloom.llm.common import materialize, partitions, salted_join
from ruleloom.llm.components import connected_components
from ruleloom.llm.simhash import least_of_component

SEED = 42
#: Bits in which the fingerprints of a link may differ.
DISTANCE = 4
BANDS, ROWS = 24, 4
#: Shingles hashed at once; texts a batch that is passed on.
BLOCK, BATCH = 1024, 512
_RANDOM = np.random.default_rng(SEED)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: max(0, len(words) - width)]]
    stops = ends[min(width, len(words)) - 1 :]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band, as signed longs; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        least = np.minimum(least, ((shingles[i : i + BLOCK] ^ _MIX) * _TIMES).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set; 0 for no shingles."""
    counts = np.zeros(simhash.BITS, np.int64)
    for i in range(0, len(shingles), 65536):
        counts += simhash.bit_counts(shingles[i : i + 65536])
    return simhash.majority(counts, len(shingles))


def shingled(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``(k, node, fp, bands, t)`` for every row; ``node`` is a hash of the set, ``fp`` its SimHash, ``t`` the text.

    The set itself stays behind: its hashes take twice the room of the text and
    don't compress, and few sets are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                fps = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
                bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(fps), bands, batch.column(1)], ["k", "node", "fp", "bands", "t"])

    keyed = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = keyed.schema["k"].dataType.simpleString()
    return keyed.mapInArrow(run, f"k {kind}, node bigint, fp bigint, bands array<bigint>, t string")


def links_among(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct non-empty sets."""
    a, b = [], []
    if len(sets) == 2:
        x, y = sets
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return ([nodes[0]], [nodes[1]]) if shared / (len(x) + len(y) - shared) >= least else (a, b)
    sizes = np.array([len(s) for s in sets])
    values, value = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mine = np.split(value, np.cumsum(sizes)[:-1])
    left = np.ones(len(sets), bool)
    queue: list[int] = []
    while left.any():
        if not queue:
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
        one = queue.pop()
        inside = np.zeros(len(values), bool)
        inside[mine[one]] = True
        shared = np.bincount(owner[inside[value]], minlength=len(sets))
        found = np.flatnonzero(left & (shared / (sizes + sizes[one] - shared) >= least))
        if len(found):
            a += [nodes[one]] * len(found)
            b += nodes[found].tolist()
            queue += found.tolist()
            left[found] = False
            stay = left[owner]
            owner, value = owner[stay], value[stay]
    return a, b


def _scan(least: float, width: int):
    def links(keys: np.ndarray, nodes: np.ndarray, texts: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        a, b = [], []
        for i, j in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            if j - i > 1:
                x, y = links_among(nodes[i:j], [shingle_set(t, width) for t in texts[i:j]], least)
                a += x
                b += y
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            k, v, t = batch["key"].to_numpy(), batch["node"].to_numpy(), batch["t"].to_numpy()
            if not len(k):
                continue
            if held and k[-1] == held[0][0][0]:  # one run goes on over the whole batch
                held.append((k, v, t))
                continue
            cut = int(np.searchsorted(k, k[-1]))
            parts = [*held, (k[:cut], v[:cut], t[:cut])]
            held = [(k[cut:], v[cut:], t[cut:])]
            if sum(len(p[0]) for p in parts):
                yield links(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        if held:
            yield links(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def cells(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(node, cell)`` of all sets with shingles: ``cell`` is the least fingerprint reachable through SimHash links."""
    sets = materialize(prints.where(F.size("bands") > 0).select("node", "fp").distinct(), "fingerprints")
    parts = connected_components(simhash.near_links(sets.select("fp").distinct(), distance))
    parts = parts.select(F.col("node").alias("of_fp"), "component")
    return salted_join(sets, parts, "fp", "of_fp", "left").select("node", F.coalesce("component", "fp").alias("cell"))


def near_links(prints: DataFrame, nodes: DataFrame, least: float = 0.8, chunk: int = 1024, width: int = 5) -> DataFrame:
    """Links ``(a, b)`` that connect all sets at a likeness of ``least`` or more.

    One text of each set is exchanged; sets are made of them where they are
    compared.
    """
    n = partitions(prints.sparkSession)
    placed = materialize(nodes.select("node", "bands").join(cells(prints), "node"), "cells")
    of_cell = lambda c: F.xxhash64(F.lit("cell"), c)
    keyed = placed.select("node", "cell", F.explode(F.concat(F.array(of_cell("cell")), "bands")).alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("cell").alias("first"), F.max("cell").alias("last"))
    # within a cell all sets are compared: a key of one cell alone has nothing to add
    groups = groups.where((F.col("members") > 1) & ((F.col("first") < F.col("last")) | (F.col("key") == of_cell("first"))))
    # near copies meet under many keys: one of those with the same members will do
    groups = materialize(groups.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / chunk).cast("int").alias("chunks")), "groups")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, F.col("own")) * F.col("chunks") + F.greatest(o, F.col("own")))
    members = keyed.join(groups, "key").withColumn("own", own).select("node", "key", F.explode(pairs).alias("pair"))
    members = materialize(members.select("node", F.xxhash64("key", "pair").alias("key")), "members")
    # a set's text comes from each task once, however many copies it has
    texts = prints.groupBy("node").agg(F.first("t").alias("t"))
    found = members.join(texts, "node").select("key", "node", "t").repartition(n, "key").sortWithinPartitions("key")
    return found.mapInPandas(_scan(least, width), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``(key, component_id)`` for every document.

    Links join texts whose shingle sets have a Jaccard similarity of ``least``
    or more; ``component_id`` is the least key reachable through links.  Null
    and empty texts are equal to each other and to nothing else.  Null keys,
    repeated rows and empty tables are as in ``simhash.near_duplicates``.
    """
    prints = materialize(shingled(docs, key, text, width), "prints")
    nodes = materialize(prints.groupBy("node").agg(F.min("k").alias("rep"), F.first("bands").alias("bands")), "nodes")
    parts = connected_components(near_links(prints, nodes, least, width=width))
    of = least_of_component(nodes.select("node", "rep"), parts).withColumnRenamed("node", "of_node")
    return salted_join(prints.select("k", "node"), of, "node", "of_node").select(F.col("k").alias(key), "component_id")
