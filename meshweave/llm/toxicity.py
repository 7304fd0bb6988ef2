"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all documents,
whether the labels know them or not. A linear model over hashed words
is trained in numpy on the class-prior-corrected risk

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

with logistic loss, where ``pi`` is the share of toxic rows among all labelled
rows of the training folds. The fit uses at most ``max_positive`` and
``max_unlabelled`` rows (lowest hash of their id first), a documented bound; every
document is scored, over its whole text. Rows of the held-out fold are not read for the fit;
labels, lang, source and doc_id are never inputs of a score.

Words are counted where the texts are; the words that tell the two samples apart are few,
and only they reach the driver, at most ``MOST_WORDS`` for each sampled row.

Edge cases: null or empty texts get the model's base score; without positives
every score is the prior's; without unlabelled rows it is the prior's too; repeated rows are scored each; a null ``doc_id`` is
held out of training and not marked ``held_out``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
FOLDS = 5
#: Slots that a model uses at most.
MOST_WORDS = 2_000
#: Words that a task remembers, and their longest; longer ones are hashed each time.
_MEMO, _LONGEST = 400_000, 64
#: ASCII letters to lower case, other ASCII bytes but digits to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def word_set(raw: bytes) -> set[bytes]:
    """The distinct folded words of a text."""
    return set(raw.translate(_FOLD).split())


def slot(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) >> (64 - BITS)


def hashed(rows: DataFrame) -> DataFrame:
    """``(key, positive, slots)`` of ``(key, positive, raw)``: the words as sorted slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [sorted({slot(w) for w in word_set(x)}) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["key", "positive", "slots"])

    return rows.mapInArrow(run, "key long, positive boolean, slots array<int>")


def fit_nnpu(positive: list, unlabelled: list, prior: float, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the slots and the bias, by full-batch Adam on the non-negative risk."""
    theta, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -4.0
    if not positive or not unlabelled:
        return theta, bias
    both = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    sizes = np.array([len(x) for x in both])
    index, inverse = np.unique(np.concatenate([np.asarray(x, np.int64) for x in both if len(x)] or [np.zeros(0, np.int64)]), return_inverse=True)
    row = np.repeat(np.arange(n_p + n_u), sizes)
    w, m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    w[-1] = bias
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[inverse], minlength=n_p + n_u) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # derivative of the loss at label -1; s - 1 at label +1
        p, u = slice(0, n_p), slice(n_p, None)
        softplus = np.logaddexp(0, z)
        negative = softplus[u].mean() - prior * softplus[p].mean()
        g = np.empty(n_p + n_u)
        if negative >= 0:
            g[p] = prior * (s[p] - 1) / n_p - prior * s[p] / n_p
            g[u] = s[u] / n_u
        else:  # the estimate of the negatives' risk fell below zero: step back from it
            g[p] = prior * s[p] / n_p
            g[u] = -s[u] / n_u
        grad = np.append(np.bincount(inverse, weights=g[row], minlength=len(index)) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta[index] = w[:-1]
    return theta, float(w[-1])


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least_z: float = 3.5, least_rows: int = 5) -> np.ndarray:
    """The slots that tell two samples apart, of how many rows hold each: their shares of rows differ by ``least_z`` errors.

    At most ``MOST_WORDS``, the most telling first.
    """
    n_p, n_u = max(1, n_p), max(1, n_u)
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    at = np.nonzero((z >= least_z) & (in_p + in_u >= least_rows))[0]
    return np.sort(at[np.argsort(-z[at], kind="stable")[:MOST_WORDS]])


def thinned(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """``key, positive, slots`` with the slots in ``kept`` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [[int(s) for s in x.values.to_numpy() if s in held] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["key", "positive", "slots"])

    held = set(kept.tolist())
    return rows.mapInArrow(run, "key long, positive boolean, slots array<int>")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4_000, max_unlabelled: int = 12_000) -> tuple[np.ndarray, float]:
    """Fit on the training folds."""
    common.bound_batches(docs.sparkSession)
    usable = F.col("doc_id").isNotNull() & (fold_of("doc_id") != 0)
    marked = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior or prior >= 1:
        return fit_nnpu([], [], prior or 1e-3)
    first = lambda df, flag, n: df.select(F.col("doc_id").alias("key"), F.lit(flag).alias("positive")).distinct().orderBy(F.xxhash64("key", F.lit(flag)), "key").limit(n)
    chosen = first(marked.where("toxic = 1"), True, max_positive).unionByName(first(docs.where(usable), False, max_unlabelled))
    # At most max_positive + max_unlabelled ids: small enough to broadcast.
    texts = docs.select(F.col("doc_id").alias("key"), common.text_of("text").cast("binary").alias("raw"))
    rows = common.cut(hashed(texts.join(F.broadcast(chosen), "key").select("key", "positive", "raw")))
    sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    held = rows.select("positive", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).toArrow()  # at most 2 ** BITS rows
    in_p, in_u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    in_p[held.column("slot").to_numpy()], in_u[held.column("slot").to_numpy()] = held.column("p").to_numpy(), held.column("u").to_numpy()
    few = thinned(rows, telling(in_p, in_u, sizes.get(True, 0), sizes.get(False, 0))).orderBy("key", "positive", "slots").toArrow()
    slots, flags = few.column("slots").to_pylist(), few.column("positive").to_pylist()
    return fit_nnpu([s for s, f in zip(slots, flags) if f], [s for s, f in zip(slots, flags) if not f], prior)


def score(docs: DataFrame, theta: np.ndarray, bias: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    common.bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))  # 2 ** BITS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, memo = model.value, {}
        for batch in batches:
            out = []
            for x in batch.column(2):
                words = word_set(x.as_buffer().to_pybytes() if x.is_valid else b"")
                new = words.difference(memo)
                if len(memo) + len(new) > _MEMO:
                    memo.clear()
                    new = words
                held = {w: slot(w) for w in new}
                memo.update((w, n) for w, n in held.items() if len(w) <= _LONGEST)
                slots = np.fromiter({held[w] if w in held else memo[w] for w in words}, np.int64)
                z = bias + float(np.sum(np.sort(weights[slots]), dtype=np.float64))
                out.append(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score(docs, *train(docs, labels, **bounds))
