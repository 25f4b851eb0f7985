"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingle hashes have
it set.  Two fingerprints that differ in at most ``d`` bits, cut into
``d // 2 + 1`` segments, agree in one segment up to a single bit.  So each
fingerprint is indexed under every segment with every single bit of it left
out; fingerprints within ``d`` bits meet under one of these keys, whatever
their other bits, and are verified there.  Equal fingerprints are one node.

Under a key, links are found by a breadth-first walk over the members, which
keeps a spanning forest of the true links: connected texts stay connected, and
a group of near copies yields one link a member instead of all pairs.  Keys
with more than ``chunk`` members are cut into chunks, and each pair of chunks
is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import materialize, partitions, salted_join
from ruleloom.llm.components import connected_components

SEED = 42
BITS = 64
#: Runs up to this length are compared by shifting whole batches.
SHORT_RUN = 48


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit set, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, total: int) -> int:
    """The fingerprint whose bits are those that over half of ``total`` hashes have."""
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), len(starts)
    for k in range(0, total, 65536):
        counts += bit_counts(np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)], np.uint64))
    return majority(counts, total)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``(key, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["k", "fp"])

    keyed = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = keyed.schema["k"].dataType.simpleString()
    return keyed.mapInArrow(run, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def variant_keys(fp: str = "fp", distance: int = 4):
    """The array of one-wildcard segment keys of a fingerprint column."""
    pieces = distance // 2 + 1
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    keys, tag = [], 0
    for low, high in zip(cuts, cuts[1:], strict=False):
        for bit in range(low, high):
            mask = sum(1 << b for b in range(low, high) if b != bit)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.shiftrightunsigned(F.col(fp).bitwiseAND(F.lit(signed).cast("bigint")), low) + F.lit(tag << 33))
            tag += 1
    return F.array(*keys)


def _walk(members: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints."""
    left, a, b = members, [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            layer = queue.pop()
            for one in layer:
                near = np.bitwise_count(left ^ one) <= distance
                if near.any():
                    found = left[near]
                    a.append(np.full(len(found), one))
                    b.append(found)
                    queue.append(found)
                    left = left[~near]
                    if not len(left):
                        break
    return a, b


def links_in_runs(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key; whole runs only."""
    fps = fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    short = sizes <= SHORT_RUN
    inside = np.repeat(short, sizes)
    remain = np.repeat(starts + sizes, sizes) - np.arange(len(keys))
    rows = np.flatnonzero(inside & (remain > 1))
    lag = 1
    while len(rows):
        near = np.bitwise_count(fps[rows] ^ fps[rows + lag]) <= distance
        a.append(fps[rows[near]])
        b.append(fps[rows[near] + lag])
        lag += 1
        rows = rows[remain[rows] > lag]
    for i, n in zip(starts[~short], sizes[~short], strict=True):
        x, y = _walk(np.unique(fps[i : i + n]), distance)
        a += x
        b += y
    empty = np.zeros(0, np.uint64)
    return np.concatenate(a or [empty]).view(np.int64), np.concatenate(b or [empty]).view(np.int64)


def _scan(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = [], []
        for batch in batches:
            k, f = batch["key"].to_numpy(), batch["fp"].to_numpy()
            if not len(k):
                continue
            if held_k and k[-1] == held_k[0][0]:  # one run goes on over the whole batch
                held_k.append(k)
                held_f.append(f)
                continue
            cut = int(np.searchsorted(k, k[-1]))
            a, b = links_in_runs(np.concatenate([*held_k, k[:cut]]), np.concatenate([*held_f, f[:cut]]), distance)
            held_k, held_f = [k[cut:]], [f[cut:]]
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})
        if held_k:
            a, b = links_in_runs(np.concatenate(held_k), np.concatenate(held_f), distance)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def near_links(nodes: DataFrame, distance: int = 4, chunk: int = 8192) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``distance`` bits."""
    n = partitions(nodes.sparkSession)
    # every node becomes 64 rows: spread the nodes first
    keyed = nodes.select("fp").repartition(n).select("fp", F.explode(variant_keys("fp", distance)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > chunk)
    hot = materialize(hot.select("key", F.ceil(F.col("members") / chunk).cast("int").alias("chunks")), "hot")
    cold = keyed
    crowded = None
    if not hot.isEmpty():
        cold = keyed.join(hot.select("key"), "key", "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, F.col("own")) * F.col("chunks") + F.greatest(o, F.col("own")))
        crowded = keyed.join(hot, "key").withColumn("own", own).select("fp", F.explode(pairs).alias("pair"), F.col("key").alias("variant"))
        # one key per pair of chunks
        crowded = crowded.select(F.xxhash64("variant", "pair").alias("key"), "fp")
    found = cold.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInPandas(_scan(distance), "a bigint, b bigint")
    if crowded is not None:
        found = found.union(crowded.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_scan(distance), "a bigint, b bigint"))
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``(key, fp, component_id)`` for every document.

    Links join fingerprints at ``distance`` or fewer differing bits;
    ``component_id`` is the least key reachable through links, the document's
    own key included.  Null and empty texts have fingerprint 0 and are linked
    like any other.  A null key keeps its row; it never becomes a component id
    unless all keys of the component are null.  Repeated rows are kept.  Texts
    of any length are read whole.  An empty table gives an empty result; other
    columns are ignored.
    """
    prints = materialize(fingerprints(docs, key, text, width), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("rep")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), distance))
    of = least_of_component(nodes, parts)
    return salted_join(prints, of.withColumnRenamed("node", "node_fp"), "fp", "node_fp").select(key, "fp", "component_id")


def least_of_component(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``(node, component_id)``: the least ``rep`` of each node's component.

    ``nodes`` has a node in its first column and ``rep``; ``parts`` is what
    ``connected_components`` found.  Nodes without links keep their own.
    """
    nodes = nodes.select(F.col(nodes.columns[0]).alias("own"), "rep")
    linked = materialize(nodes.join(parts, F.col("own") == F.col("node")).select("own", "rep", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "root")
    found = salted_join(linked, least, "component", "root").select(F.col("own").alias("node"), "component_id")
    alone = nodes.join(linked.select(F.col("own").alias("seen")), F.col("own") == F.col("seen"), "left_anti")
    return materialize(found.unionByName(alone.select(F.col("own").alias("node"), F.col("rep").alias("component_id"))), "members")


def hex_digits(fp):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
