"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A recipe with one entry per source: its words and its target (weights 3, 1, 2,
   repeating in code-point order of the sources, share 150 % of all words; a target
   stops at ``max_passes`` times its source, the excess goes to the others by weight).
2. The documents of a source stand in a seeded order; the line of their words is
   cut into near-equal blocks. A target is an exact number of block draws: whole
   passes over the blocks, then a part of one more pass, the last draw in part.
3. A tree splits the sources' draws among output shards: each node hands its left
   half a multivariate-hypergeometric part of its quotas, so quotas stay exact.
4. Shards own disjoint runs of each source's permuted blocks (a keyed Feistel
   permutation, one key per source and pass), and a random slot orders each shard.

Only the recipe reaches the driver: one row per source, and per source and shard
a number, ``RECIPE_NUMBERS`` in all at most. Positions of documents come from prefix sums over buckets of about
``max(500, sqrt(rows))`` rows, so a hot source is spread over many tasks.

Edge cases: null texts have no words and are never taken; a null source is a source
of its own, last in order; null ids take part; documents with equal ids are told apart by
their sizes and texts, and rows equal in all of these are interchangeable; an empty table gives
an empty mix; other columns pass through ``mix``, but those with the names of the columns it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1_024
SHARD_WORDS = 4_000_000
#: Numbers in the recipe at most: with very many sources the shards are larger.
RECIPE_NUMBERS = 20_000_000
#: The sampler of the tree takes fewer than 10 ** 9 draws; blocks grow beyond that.
MOST_DRAWS = 400_000_000


@dataclass
class Source:
    """One entry of the recipe; ``owned[k]`` is the first draw of shard k."""

    name: str | None
    size: int
    target: Fraction
    blocks: int = 0
    full: int = 0  # whole draws
    part: int = 0  # words of the last, partial draw
    owned: np.ndarray | None = None

    @property
    def draws(self) -> int:
        return self.full + (self.part > 0)


def targets(sizes: list[int], weights: list[int], share: Fraction, most: Fraction) -> list[Fraction]:
    """Share ``share`` of all sizes by weight; none gets over ``most`` times its size."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas by (shard, source): a tree of multivariate-hypergeometric splits."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        first, last, have = todo.pop()
        if last - first == 1:
            out[first] = have
            continue
        middle = (first + last) // 2
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (middle - first) // (last - first), method="marginals")
        todo += [(middle, last, have - left), (first, middle, left)]
    return out


def recipe(totals: list[tuple[str | None, int]], seed: int, weights=WEIGHTS, share: Fraction = Fraction(3, 2), max_passes: int = 2) -> tuple[list[Source], int]:
    """The sources in order with their targets, blocks and shards' draws; the number of shards."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in ordered], [weights[i % len(weights)] for i in range(len(ordered))], share, Fraction(max_passes))
    sources = [Source(name, size, target) for (name, size), target in zip(ordered, goal)]
    block = max(BLOCK_WORDS, math.ceil(sum(goal) / MOST_DRAWS))
    for s in sources:
        if s.size:
            words = round(s.target)
            s.blocks = max(1, min(s.size, max(64, math.ceil(s.size / block))))
            passes, rest = divmod(words, s.size)
            more = rest * s.blocks // s.size
            s.full = passes * s.blocks + more
            s.part = max(0, rest - round(Fraction(more * s.size, s.blocks)))
    shards = max(1, min(65_536, math.ceil(sum(goal) / SHARD_WORDS), RECIPE_NUMBERS // max(1, len(sources))))
    if sources:
        tree = split(np.array([s.draws for s in sources]), shards, np.random.default_rng(seed))
        for i, s in enumerate(sources):
            s.owned = np.concatenate([[0], np.cumsum(tree[:, i])])
    return sources, shards


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each ``x`` in [0, n) under a keyed permutation (Feistel, cycle walking)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(xxhash.xxh64_intdigest(key.to_bytes(8, "little"), r) | 1) for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in rounds:
            mixed = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * r
            left, right = right, (left ^ (mixed >> np.uint64(29))) & mask
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def key_of(seed: int, *parts) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode(), seed)


def pieces(s: Source, start: int, size: int, seed: int) -> list[np.ndarray]:
    """What the mix takes of the words [start, start + size) of a source's line.

    Columns: shard, slot, pass, first word within the document, number of words.
    """
    if not size or not s.draws:
        return [np.zeros(0, np.int64)] * 5
    base, extra = divmod(s.size, s.blocks)

    def block_of(word: int) -> int:
        return word // (base + 1) if word < extra * (base + 1) else extra + (word - extra * (base + 1)) // base

    j = np.arange(block_of(start), block_of(start + size - 1) + 1)
    begin = j * base + np.minimum(j, extra)
    end = begin + base + (j < extra)
    low, high = np.maximum(begin, start), np.minimum(end, start + size)
    cols = []
    for turn in range(-(-s.draws // s.blocks)):
        draw = turn * s.blocks + permuted(j, s.blocks, key_of(seed, "block", s.name, turn))
        top = np.where(draw < s.full, high, np.minimum(high, begin + s.part))
        taken = np.nonzero((draw < s.draws) & (top > low))[0]
        shard = np.searchsorted(s.owned, draw[taken], side="right") - 1
        slot = (draw[taken].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key_of(seed, "slot", s.name))) >> np.uint64(1)
        cols.append((shard, slot.astype(np.int64), np.full(len(taken), turn), low[taken] - start, (top - low)[taken]))
    return [np.concatenate(c) for c in zip(*cols)]


PIECE = "struct<shard:int,slot:long,turn:int,first:int,words:int>"


def plan(docs: DataFrame, columns: list[str], seed: int = 17, **how) -> tuple[DataFrame, int]:
    """``row`` (a struct of ``columns``), ``size, source_size, target`` and ``pieces``, all that the mix takes of a row, of every row; and the number of shards."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    sized = docs.select(own.alias("row"), "doc_id", "source", common.n_words("text").alias("size"), F.xxhash64("text").alias("print"))
    if "text" not in columns:  # small rows: sizes are counted once
        sized = common.cut(sized)
    rows = docs.count()
    buckets = max(1, round(rows / max(500, math.isqrt(rows))))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = sized.withColumns({
        "group": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")),
        "order": order,
        "bucket": F.pmod(F.shiftrightunsigned(order, 8), F.lit(buckets)),
    })
    per = placed.groupBy("group", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = common.cut(per.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))))
    found = per.groupBy("group").agg(F.sum("sum").alias("size")).collect()  # one row per source
    sources, shards = recipe([(r["group"][1:] if r["group"][0] == "v" else None, int(r["size"] or 0)) for r in found], seed, **how)
    known = spark.sparkContext.broadcast({s.name: s for s in sources})  # the recipe

    line = Window.partitionBy("group", "bucket").orderBy("order", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(per.drop("sum"), ["group", "bucket"]).select("row", "source", "size", (F.col("before") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recipe_ = known.value
        fields = [("shard", pa.int32()), ("slot", pa.int64()), ("turn", pa.int32()), ("first", pa.int32()), ("words", pa.int32())]
        for batch in batches:
            sources_, sizes, starts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            own = [recipe_[x] for x in sources_]
            made = [pieces(s, a, n, seed) for s, a, n in zip(own, starts, sizes)]
            flat = [np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64) for i in range(5)]
            struct = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(flat, fields)], names=[n for n, _ in fields])
            ends = np.cumsum([0, *(len(m[0]) for m in made)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.size for s in own], pa.int64()), pa.array([float(s.target) for s in own], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)],
                names=["row", "size", "source_size", "target", "pieces"],
            )

    schema = T.StructType([T.StructField("row", placed.schema["row"].dataType), *T._parse_datatype_string(f"size long, source_size long, target double, pieces array<{PIECE}>").fields])
    return placed.mapInArrow(run, schema), shards


def taken_words(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, and ``by_shard``: the pieces that each output shard takes of it."""
    made, _ = plan(docs, ["doc_id"], seed, **how)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken")
    shard = F.array_sort(F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["turn"].alias("turn"), p["first"].alias("first_word"), p["words"].alias("words"))))
    return made.select("row.doc_id", "size", "source_size", "target", taken, shard.alias("by_shard"))


def mix(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mix itself: a row for each piece taken, its text in ``text``.

    Adds ``shard, slot, turn, first_word, n_words_taken``; a partition holds whole shards, each shuffled by ``slot``.
    A piece that is a whole document keeps its text, another has its words joined by one space.
    """
    made, shards = plan(docs, docs.columns, seed, **how)
    added = ["shard", "slot", "turn", "first_word", "n_words_taken"]
    text = F.col("row.text")
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    whole = lambda p: (p["first"] == 0) & (p["words"] == F.col("size"))
    cut = lambda w: F.transform("pieces", lambda p: F.when(~whole(p), F.array_join(F.slice(w, p["first"] + 1, p["words"]), " ")))
    parts = F.when(F.forall("pieces", whole), F.transform("pieces", lambda p: F.lit(None).cast("string"))).otherwise(common.once(words, cut))
    rows = made.where(F.size("pieces") > 0).select("row", F.explode(F.arrays_zip(F.col("pieces").alias("p"), parts.alias("part"))).alias("x"))
    kept = [F.coalesce("x.part", text).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    rows = rows.select(*kept, *[F.col(f"x.p.{a}").alias(b) for a, b in zip(("shard", "slot", "turn", "first", "words"), added)])
    return rows.repartition(max(shards, common.partitions(docs)), "shard").sortWithinPartitions("shard", "slot", "turn")
