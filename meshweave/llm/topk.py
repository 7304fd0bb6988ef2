"""Exact top-k search: tiled matrix products, partial selection, tree merging.

Candidates and queries are packed into blocks of bounded size, one row each. Every
query block meets every candidate block once, as a tile: candidate blocks are dealt
to groups, and query blocks are sent to each group, so a tile's task holds one block
of either side. A tile is a float64 matrix product, exact while every partial sum
stays below 2 ** 53 and done in 64-bit integers otherwise; its scores are
selected against the running k-th best of each query. Lists of one group and query
block are merged in the task, those of a query by a tree over the groups.

Edge cases: a vector that is null, or holds a null, NaN or infinite component, takes
no part, nor does a row with null id; vectors of other lengths than the query's are
no candidates of it; ties go to the smaller id; a repeated row is a candidate of its
own (and no row with the query's id is one); of several queries with one id the least
vector counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_ROWS = 2_048
QUERY_ROWS = 1_024
#: Candidate blocks of one group, so its lists are merged before they are shuffled.
GROUP_BLOCKS = 16
FAN = 8
#: Query rows of a tile that are multiplied at once.
STRIP = 256


def quantised(rows: DataFrame, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: each component x as floor(scale * x), x as double; unusable rows left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    usable = F.col(id).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(usable).select(F.col(id).cast("long").alias("id"), whole.alias("v"))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """``block, dim, ids, data``: rows packed into blocks of at most ``most`` rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int, parts: list) -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            data = data[order]
            small = np.int32 if len(data) == 0 or dim == 0 or max(int(data.max()), -int(data.min())) < 1 << 31 else np.int64
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([data.astype(small).tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            sizes = np.diff(ends)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                data = flat[(ends[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim).astype(np.int64)
                for start in range(0, len(at), most):
                    held.setdefault(int(dim), []).append((ids[at[start : start + most]], data[start : start + most]))
                    if sum(len(p[0]) for p in held[int(dim)]) >= most:
                        parts = held.pop(int(dim))
                        over = sum(len(p[0]) for p in parts) - most
                        if over > 0:
                            tail_ids, tail = parts[-1]
                            parts[-1] = (tail_ids[:-over], tail[:-over])
                            held[int(dim)] = [(tail_ids[-over:], tail[-over:])]
                        yield row(int(dim), parts)
        for dim, parts in held.items():
            yield row(dim, parts)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


class Best:
    """The running top ``k`` of each row of a query block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.have = np.zeros(n, np.int64)

    def offer(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[row, : self.have[row]], score])
        ids = np.concatenate([self.id[row, : self.have[row]], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.have[row] = len(order)
        self.score[row, : len(order)], self.id[row, : len(order)] = score[order], ids[order]

    def tile(self, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        """Offer a candidate block; ``ids`` ascend."""
        dim = q.shape[1]
        top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
        exact = top(q) * top(c) * max(1, dim) < 1 << 53
        kind = np.float64 if exact else np.int64
        right = np.ascontiguousarray(c.T.astype(kind))
        for start in range(0, len(q), STRIP):
            score = q[start : start + STRIP].astype(kind) @ right
            for i in range(len(score)):
                row, s = start + i, score[i]
                full = self.have[row] == self.k
                at = np.nonzero(s >= self.score[row, -1])[0] if full else np.arange(len(s))
                at = at[ids[at] != query_ids[row]]
                if len(at) > 4 * self.k:  # the best k, of those that tie the first: ids ascend
                    bar = np.partition(s[at], len(at) - self.k)[len(at) - self.k]
                    above = at[s[at] > bar]
                    at = np.concatenate([above, at[s[at] == bar][: self.k - len(above)]])
                if len(at):
                    self.offer(row, s[at].astype(np.int64), ids[at])


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query.

    Both sides have ``id`` and ``v`` (array of long); a candidate with the query's id is left out.
    """
    spark = candidates.sparkSession
    common.bound_batches(spark)
    tiles = common.written(packed(candidates, BLOCK_ROWS), "candidates")
    asked = queries.count()
    once = queries.repartition(max(1, asked // (4 * QUERY_ROWS)), "id").groupBy("id").agg(F.min("v").alias("v"))
    ours = common.written(packed(once, QUERY_ROWS), "queries")
    blocks = tiles.count()
    groups = max(1, math.ceil(blocks / GROUP_BLOCKS), min(blocks, common.partitions(candidates)))
    group = lambda n: F.xxhash64(n, "dim")  # noqa: E731 - blocks of one length and group meet
    left = tiles.select("dim", F.col("ids").alias("c_ids"), F.col("data").alias("c"), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("n"))
    sent = ours.select(F.col("dim").alias("q_dim"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q"), F.xxhash64("ids").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("n"))
    left = left.withColumn("key", group("n")).repartition(groups, "key")
    sent = sent.withColumn("key", group("n")).drop("n", "dim").repartition(groups, "key")
    met = left.join(sent, "key").where(F.col("dim") == F.col("q_dim")).withColumnRenamed("n", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, Best]] = {}

        def lists() -> Iterator[pa.RecordBatch]:
            for (group, _), (query_ids, best) in held.items():
                mask = np.arange(k)[None, :] < best.have[:, None]
                rows = np.repeat(np.arange(len(query_ids)), best.have)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), group), pa.int32()), pa.array(query_ids[rows]), pa.array(best.id[mask]), pa.array(best.score[mask])], names=["group", "query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for group, dim, block, q_ids, q, c_ids, c in zip(*(batch.column(i).to_pylist() for i in range(7))):
                key = (group, block)
                if key not in held and len(held) >= 64:
                    yield from lists()
                array = lambda data, n: np.frombuffer(data, np.int32 if len(data) == 4 * n * dim else np.int64).reshape(n, dim)
                query_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                if key not in held:
                    held[key] = (query_ids, Best(len(query_ids), k))
                held[key][1].tile(query_ids, array(q, len(query_ids)), ids, array(c, len(ids)))
        yield from lists()

    found = met.select("group", "dim", "block", "q_ids", "q", "c_ids", "c").mapInArrow(run, "group int, query_id long, vec_id long, score long")
    level = groups
    while level > FAN:  # merge FAN groups' lists of a query at a time
        level = math.ceil(level / FAN)
        order = Window.partitionBy("query_id", "group").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("group", F.floor(F.col("group") / FAN).cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
