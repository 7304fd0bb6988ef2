"""Quality selection by importance resampling of hashed n-gram models.

Two generative models count hashed word and punctuation unigrams and bigrams: the
raw model over *all* documents, the target model over good labelled rows (at most
``max_labelled``, lowest hash of their id first, a documented bound of the fit). A
document's log weight is the sum over its n-grams of log target / raw: the log of how
likelier the target model makes it. Documents are resampled without replacement by Gumbel
top-k: the ``k`` largest sums of log weight and seeded Gumbel noise. Rows labelled bad are not used.

``k`` defaults to the number of documents, counted over the whole corpus, that weigh at
least as much as the lowest of ``keep_good`` of the good rows; those rows are every fifth of
the good ones, weighed by a target model of the others. The k-th largest key is found exactly
by counting keys in ever finer ranges; rows that tie at it are taken by smaller id.

Edge cases: null or empty texts have weight zero and no n-grams and are kept as their
noise allows; repeated rows have equal keys and stand or fall together; a null
``doc_id`` ranks after others in a tie; without good labelled rows all documents are kept.
An empty table gives an empty result; other columns pass through ``select``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .simhash import LOWER

BITS = 16
SLOTS = 1 << BITS
SMOOTHING = 0.5
#: Words that a task remembers, and their longest; longer ones are hashed each time.
_MEMO, _LONGEST = 300_000, 64
#: Good rows that ``k`` must rest on at least; with fewer, the model's own rows are weighed.
_HELD_OUT = 20
#: Runs of letters, digits, underscores and non-ASCII bytes; runs of punctuation.
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+")
_SHIFT = np.uint64(64 - BITS)


class Hasher:
    """The slots of a text's unigrams and bigrams; remembers words of the task."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def slots(self, raw: bytes) -> Iterator[np.ndarray]:
        """Slots of the n-grams, part by part of a long text."""
        last = None
        for part in common.parts(raw.translate(LOWER)):
            words = _TOKEN.findall(part)
            if not words:
                continue
            seen = set(words)
            new = seen.difference(self.memo)
            if len(self.memo) + len(new) > _MEMO:
                self.memo.clear()
                new = seen
            long = {}
            for word in new:
                (self.memo if len(word) <= _LONGEST else long)[word] = xxhash.xxh64_intdigest(word, 9)
            of = {**self.memo, **long}.__getitem__ if long else self.memo.__getitem__
            ids = np.fromiter(map(of, words), np.uint64, len(words))
            run = ids if last is None else np.concatenate([last, ids])
            pairs = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + (run[1:] ^ (run[1:] >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield (np.concatenate([ids, pairs ^ (pairs >> np.uint64(29))]) >> _SHIFT).astype(np.int64)
            last = ids[-1:]


def counts(texts: DataFrame) -> np.ndarray:
    """How often each slot occurs over all of ``texts`` (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    for slots in hasher.slots(x.as_buffer().to_pybytes()):
                        total += np.bincount(slots, minlength=SLOTS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each slot, smoothed."""
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * SLOTS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * SLOTS)
    return np.log(p / q)


def weigh(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``row, log_weight, n_grams`` of ``rows``, each whole in the struct ``row``; its text is in ``text``."""
    model = rows.sparkSession.sparkContext.broadcast(ratio)  # SLOTS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratios = Hasher(), model.value
        for batch in batches:
            weight, n = [], []
            for x in pc.struct_field(batch.column(0), "text"):
                sums = [(ratios[s].sum(), len(s)) for s in hasher.slots(x.as_buffer().to_pybytes())] if x.is_valid else []
                weight.append(float(sum(w for w, _ in sums)))
                n.append(sum(m for _, m in sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, pa.float64()), pa.array(n, pa.int64())], names=["row", "log_weight", "n_grams"])

    schema = T.StructType([T.StructField("row", T.StructType(rows.schema.fields)), T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).mapInArrow(run, schema)


def gumbel_key(seed: int) -> F.Column:
    """The key of a row: its log weight and Gumbel noise of its id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row.doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.col("log_weight") - F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int | None, bool]:
    """The k-th largest of ``key``: its value, and the last ``doc_id`` kept among its ties.

    Each round counts the keys in 4,096 ranges and goes on within one of them; the
    third value tells whether null ids that tie are kept.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    need = k
    while low < high:
        step = (high - low) / 4096
        if step == 0 or low + step == low:
            break
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(4095))
        inside = keys.where((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        found = sorted(inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), reverse=True)
        for r in found:
            if need <= r["n"]:
                low, high = r["low"], r["high"]
                break
            need -= r["n"]
    ties = keys.where((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
    # rows with one key: one id's rows, or a rare meeting of noise; the last of them by id
    last = ties.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.col("doc_id").asc_nulls_last()).limit(need).collect()
    for r in last:
        need -= r["n"]
        if need <= 0:
            return low, r["doc_id"], r["doc_id"] is None
    return low, None, True


class Selector:
    """Models, number of documents drawn and Gumbel top-k threshold, fitted over the whole corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29, keep_good: float = 0.995, max_labelled: int = 12_000):
        common.bound_batches(docs.sparkSession)
        self.seed = seed
        raw = docs.select("doc_id", "text")
        good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
        chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id")  # at most max_labelled rows: small enough to broadcast
        sample = common.cut(raw.join(F.broadcast(chosen), "doc_id").withColumn("fifth", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 0))
        of_raw, held, others = counts(raw), *(counts(sample.where(F.col("fifth") == x)) for x in (True, False))
        self.ratio = log_ratio(held + others, of_raw)
        seen = weigh(sample.where("fifth"), log_ratio(others, of_raw)).select("log_weight").toArrow()
        if seen.num_rows < _HELD_OUT:
            seen = weigh(sample, self.ratio).select("log_weight").toArrow()
        self.cut = float(np.quantile(seen.column(0).to_numpy(), 1 - keep_good)) if seen.num_rows else -np.inf
        self.scored = common.cut(weigh(raw, self.ratio).withColumn("key", gumbel_key(seed)).select("row.doc_id", "log_weight", "n_grams", "key"))
        rows = self.scored.count()
        self.k = self.scored.where(F.col("log_weight") >= F.lit(self.cut)).count() if k is None else min(k, rows)
        if self.k >= rows:
            self.least = None
        elif self.k == 0:
            self.least = (np.inf, None, False)
        else:
            self.least = kth_largest(self.scored.select("doc_id", "key"), self.k)

    def kept(self, key: F.Column, doc_id: F.Column) -> F.Column:
        """Whether a row is among the k drawn."""
        if self.least is None:
            return F.lit(True)
        value, last, nulls = self.least
        tie = F.lit(True) if nulls else F.lit(False) if last is None else F.coalesce(doc_id <= F.lit(last), F.lit(False))
        return (key > F.lit(value)) | ((key == F.lit(value)) & tie)

    def scores(self) -> DataFrame:
        """``doc_id, log_weight, n_grams, key, kept`` of every document."""
        return self.scored.select("doc_id", "log_weight", "n_grams", "key", self.kept(F.col("key"), F.col("doc_id")).alias("kept"))

    def select(self, docs: DataFrame) -> DataFrame:
        """The documents drawn; weighs them again rather than shuffle their texts."""
        return weigh(docs, self.ratio).where(self.kept(gumbel_key(self.seed), F.col("row.doc_id"))).select("row.*")


def quality_selection(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, log_weight, n_grams, key, kept`` of every document."""
    return Selector(docs, labels, **how).scores()
