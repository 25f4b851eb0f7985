"""Exact top-k inner products over norm-sorted vectors.

Components become integers (``floor(scale * x)``).  Vectors are processed in
blocks by descending length.  A rotation by the singular vectors of all data
gathers the length in the first coordinates, so that a partial inner product
over a few of them plus, by Cauchy-Schwarz, the product of the residual
lengths bounds the whole.  Every query first meets the longest vectors, which
gives a floor under its k-th score; blocks and vectors whose bound stays below
a query's floor are pruned, and what remains is scored exactly in integers.

Queries are cut into blocks of like need: the least length a vector must have
to reach the floor of one of the block's queries.  A candidate is only copied
to the blocks that its length can serve, so pruning comes before the exchange.
A task holds one block of queries and streams candidates, so memory is bounded
at any size.  What reaches the driver: the second-moment matrix (dimension
squared), ``BLOCK`` longest vectors, and one number a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import discard, materialize, partitions

#: Vectors in a block of queries and of candidates.
QUERY_BLOCK, BLOCK = 1024, 4096
#: Integer inner products below this are exact in doubles.
EXACT = float(1 << 53)
#: Rounding of bounds, generously.
_SLACK = 1e-9
_RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return values.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(n), dim), np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, v, length)``: integer components and their Euclidean length.

    Vectors that are null or hold a null or non-finite component are left out,
    and so are rows whose key is null.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.when(good, F.transform(x, lambda c: F.floor(c * float(scale)).cast("bigint"))).alias("v"))
    d = d.where("v is not null and id is not null")
    return d.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, from their second moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(moments, "i int, row array<double>")
    rows = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # dim squared
    total = np.zeros((dim, dim))
    for r in rows:
        total[r[0], r[1]] = r[2]
    return np.linalg.eigh(total / max(1.0, np.abs(total).max()))[1][:, ::-1].copy()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products, held at the ends of 64 bits."""
    if exact:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64)
    whole = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(axis=1))


class Search:
    """A block of queries that meets candidates in descending length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int, head: int):
        self.ids, self.rows, self.k, self.head, self.turn = ids, rows, k, head, turn
        self.rotated = rows.astype(float) @ turn
        self.length = _lengths(rows)
        self.rest = np.sqrt((self.rotated[:, head:] ** 2).sum(axis=1))
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.floor = floor.copy()

    def meet(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        slack = _SLACK * self.length * lengths.max() + 1e-6
        open_ = np.flatnonzero(self.length * lengths.max() + slack >= self.floor)
        if not len(open_):
            return
        turned = rows.astype(float) @ self.turn
        rest = np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        bound = self.rotated[open_, : self.head] @ turned[:, : self.head].T + np.outer(self.rest[open_], rest)
        exact = float(self.length.max()) * float(lengths.max()) < EXACT
        for q, b in zip(open_, bound, strict=True):
            near = np.flatnonzero((b + slack[q] >= self.floor[q]) & (ids != self.ids[q]))
            if not len(near):
                continue
            score, who = np.r_[self.scores[q], _products(rows[near], self.rows[q], exact)], np.r_[self.found[q], ids[near]]
            best = _best(score, who, self.k)
            self.scores[q], self.found[q] = score[best], who[best]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], float(score[best[-1]]))

    def table(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([*self.found, none])), pa.array(np.concatenate([*self.scores, none]))], ["query_id", "vec_id", "score"])


def _different(ids: np.ndarray, rows: np.ndarray, last: tuple | None = None) -> np.ndarray:
    """Positions of rows unlike the one before; equal rows stand together."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
    if last is not None and len(ids):
        new[0] = ids[0] != last[0] or (rows[0] != last[1]).any()
    return np.flatnonzero(new)


def _with_floors(queries: DataFrame, longest: list, dim: int, k: int) -> DataFrame:
    """``(id, v, floor, need)``: the k-th score among the longest vectors, and the length that may reach it."""
    ids = np.array([r[0] for r in longest], np.int64)
    rows = np.zeros((len(longest), dim), np.int64)
    for i, r in enumerate(longest):
        rows[i, : len(r[1])] = r[1]
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    keep = _different(ids, rows)
    ids, rows = ids[keep], rows[keep]
    most = float(_lengths(rows).max()) if len(rows) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            length = _lengths(v)
            floor = np.full(len(own), -np.inf)
            exact = most * float(length.max(initial=0.0)) < EXACT
            for i, (q, vector) in enumerate(zip(own, v, strict=True)):
                others = ids != q
                if others.sum() >= k:
                    floor[i] = np.partition(_products(rows[others], vector, exact), others.sum() - k)[others.sum() - k]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((floor > 0) & (length > 0), (floor - 1e-6) / length * (1 - 1e-6), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(need)], ["id", "v", "floor", "need"])

    return queries.mapInArrow(run, "id bigint, v array<bigint>, floor double, need double")


def top_inner_products(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, head: int = 16) -> DataFrame:
    """Each query's k highest integer inner products: ``(query_id, rank, vec_id, score)``.

    Queries are the rows whose key is divisible by ``every``; candidates are
    all rows but those with the query's own key.  Ties go to the smaller key;
    fewer than k candidates give fewer rows.  Vectors of different dimensions
    are filled up with zeros.  Scores beyond 64 bits are held at its ends.
    Rows that repeat both key and vector count once, as query and as candidate;
    rows that repeat a key with another vector count each on their own, and a
    query's k rows are the best over all its vectors.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = materialize(integer_vectors(vectors, key, vector, scale), "vectors")
    n, dim, m = v.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(F.col("id") % every == 0)).first()
    if not n or not m:
        discard(v)
        return spark.createDataFrame([], _RESULT)
    dim = max(1, dim)
    turn = rotation(v, dim)
    head = min(head, dim)
    longest = v.orderBy(F.desc("length"), "id").select("id", "v").limit(BLOCK).collect()  # BLOCK vectors at most
    blocks = -(-m // QUERY_BLOCK)
    queries = _with_floors(v.where(F.col("id") % every == 0).select("id", "v"), longest, dim, k)
    # blocks of like need; among equal needs by a hash
    queries = queries.withColumn("spread", F.xxhash64("id", "v")).repartitionByRange(blocks, "need", "spread")
    queries = materialize(queries.select(F.spark_partition_id().alias("block"), "id", "v", "floor", "need"), "queries")
    needs = sorted((r[1], r[0]) for r in queries.groupBy("block").agg(F.min("need")).collect())  # one row a block
    # candidates go to the blocks whose need their length meets, cut into stripes that all hold long and short vectors
    stripes = max(1, min(-(-partitions(spark) // len(needs)), -(-n // BLOCK)))
    stripe = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(stripes)).cast("int")
    table = F.expr("array(" + ",".join(f"named_struct('need',{need!r}D,'block',{block})" for need, block in needs) + ")")
    names = ["stripe", "block", "query", "length", "id", "v", "floor"]
    dealt_c = v.withColumn("at", F.explode(F.filter(table, lambda b: b["need"] <= F.col("length")))).select(stripe.alias("stripe"), F.col("at.block").alias("block"), F.lit(0).alias("query"), "length", "id", "v", F.lit(0.0).alias("floor"))
    dealt_q = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("query", F.lit(1)).withColumn("length", F.lit(float("inf")))
    dealt = dealt_q.select(names).unionByName(dealt_c)
    dealt = dealt.withColumn("h", F.xxhash64("v")).repartition(max(partitions(spark), stripes * len(needs)), "stripe", "block")
    dealt = dealt.sortWithinPartitions("stripe", "block", F.desc("length"), "id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, held, last = None, None, [], None

        def start() -> Search:
            ids = np.concatenate([h[0] for h in held] or [np.zeros(0, np.int64)])
            rows = np.concatenate([h[1] for h in held] or [np.zeros((0, dim), np.int64)])
            floors = np.concatenate([h[2] for h in held] or [np.zeros(0)])
            keep = _different(ids, rows)
            return Search(ids[keep], rows[keep], floors[keep], turn, k, head)

        for batch in batches:
            stripe_, block_, query = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (stripe_[1:] != stripe_[:-1]) | (block_[1:] != block_[:-1]) | (query[1:] != query[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(query)], strict=True):
                at = (stripe_[a], block_[a])
                if at != now:
                    if now is not None:
                        yield (search or start()).table()
                    now, search, held, last = at, None, [], None
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    ids, rows = part.column(4).to_numpy(), _matrix(part.column(5), dim)
                    if query[a]:
                        held.append((ids, rows, part.column(6).to_numpy()))
                        continue
                    search = search or start()
                    keep = _different(ids, rows, last)
                    last = ids[-1], rows[-1]
                    search.meet(ids[keep], rows[keep], part.column(3).to_numpy()[keep])
        if now is not None:
            yield (search or start()).table()

    found = dealt.select(names).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
