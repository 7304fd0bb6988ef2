"""Substring dedup: windows of words that also start in an earlier document.

A word is removed if a window of ``window`` consecutive words over it occurs, word for
word, in a document with a smaller id.

1. Segments: each window picks the least hash among its runs of ``ANCHOR`` words
   (winnowing), so equal windows pick equal anchors. The windows that pick one
   anchor form a segment; its anchor, its own hash and its place leave the document.
2. Equal segments are combined before and after the shuffle: all but those of the least
   document are repeats. Anchors with one segment only are done.
3. Of the anchors with several different segments, one copy of each segment goes
   to the shard of its anchor. A shard builds a compressed FM-index of them and streams
   them through it: backward search over its wavelet matrix gives matching statistics,
   and runs of at least ``window`` words that a smaller document holds are reported.
4. An anchor with more different segments than ``SHARD_SEGMENTS`` is split over several
   shards. Each indexes its own share and streams all segments of the anchor through it
   in batches, so no task holds more than a share; the work of such an anchor grows with
   the number of its segments times the number of its shares.
5. Reported places are united per document; its text is read again to hash what is kept.

Hashes are of 128 bits in all (two 64-bit sums). Texts move only for documents that
have places to look at; a bit set of fixed size, broadcast, sorts the others out.

Edge cases: null texts have no words; texts shorter than the window keep everything; a
repeated row (same id and text) is judged like its twin, rows with one id and other
texts apart, and neither repeats the other; a null id counts as larger than any; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import FmIndex

WINDOW = 50
ANCHOR = 12
SHARD_SEGMENTS = 12_000
BLOOM_BITS = 24
_MEMO = 300_000
_LAST = (1 << 63) - 1
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Sums:
    """Hashes of any runs of a document's words, by sums of powers modulo 2 ** 64."""

    def __init__(self, ids: np.ndarray, base: int):
        n = len(ids)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * power[:n], dtype=np.uint64)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Words:
    """Numbers of words, remembered within a task."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        seen = set(words)
        new = seen.difference(self.memo)
        if len(self.memo) + len(new) > _MEMO:
            self.memo.clear()
            new = seen
        for word in new:
            self.memo[word] = xxhash.xxh64_intdigest(word, 11)
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def segments(ids: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, hash, first, windows`` of each segment of a document's words."""
    n = len(ids)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    one, two = Sums(ids, _B1), Sums(ids, _B2)
    at = np.arange(n - anchor + 1)
    hashes = one.runs(at, at + anchor)
    picked = np.concatenate([  # in parts, to bound the memory of a long text
        i + np.arange(len(v)) + v.argmin(axis=1)
        for i in range(0, n - window + 1, 1 << 16)
        for v in [np.lib.stride_tricks.sliding_window_view(hashes[i : i + (1 << 16) + window - anchor], window - anchor + 1)]
    ])
    first = np.concatenate([[0], np.nonzero(picked[1:] != picked[:-1])[0] + 1])
    windows = np.diff(np.concatenate([first, [len(picked)]]))
    end = first + windows - 1 + window
    return hashes[picked[first]].view(np.int64), two.runs(first, end).view(np.int64), first, windows


def _raw(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.col("text").cast("binary").alias("raw"))


def _print(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 3)).view(np.int64))


def summaries(docs: DataFrame) -> DataFrame:
    """``doc, print, n_words, sha``: each row whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                raw = _raw(x)
                words = raw.split()
                out.append((_print(raw), len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc", "print", "n_words", "sha"])

    return _rows(docs).mapInArrow(run, "doc long, print long, n_words long, sha string")


def occurrences(docs: DataFrame) -> DataFrame:
    """``anchor, seg, doc, print, first, windows`` of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            cols = [[] for _ in range(6)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = _raw(x)
                anchor, seg, first, windows = segments(known.ids(raw.split()))
                for col, values in zip(cols, (anchor, seg, np.full(len(first), doc), np.full(len(first), _print(raw)), first.astype(np.int32), windows.astype(np.int32))):
                    col.append(values)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "seg", "doc", "print", "first", "windows"])

    return _rows(docs).mapInArrow(run, "anchor long, seg long, doc long, print long, first int, windows int")


def bit_set(ids: DataFrame):
    """A broadcast bit set of ``doc``'s hashes, of ``2 ** BLOOM_BITS`` bits whatever the corpus."""
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << BLOOM_BITS))
    words = ids.select((place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(held.view(np.uint64))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, print, raw`` of the rows whose id is (or may be) in ``wanted``; each distinct row once."""
    held = bit_set(wanted.select("doc").distinct())
    rows = _rows(docs).withColumn("place", F.pmod(F.xxhash64("doc"), F.lit(1 << BLOOM_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            inside = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            kept = batch.filter(pa.array(inside.astype(bool)))
            prints = [_print(_raw(x)) for x in kept.column(1)]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(prints, pa.int64()), kept.column(1)], names=["doc", "print", "raw"])

    return rows.mapInArrow(run, "doc long, print long, raw binary")


def joined_places(docs: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """``doc, print, raw, places``: texts with their places, gathered per text."""
    per = places.groupBy("doc", "print").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("places"))
    per = common.cut(per)
    return texts_of(docs, per).join(per, ["doc", "print"]).groupBy("doc", "print").agg(F.first("raw").alias("raw"), F.first("places").alias("places"))


def segment_words(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``anchor, shares, seg, doc, words``: the words of each needed segment."""
    rows = joined_places(docs, needed, ["anchor", "shares", "seg", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, places in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                words = raw.split()
                out += [(p["anchor"], p["shares"], p["seg"], doc, b" ".join(words[p["first"] : p["first"] + p["windows"] - 1 + WINDOW])) for p in places]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["anchor", "shares", "seg", "doc", "words"])

    return rows.mapInArrow(run, "anchor long, shares int, seg long, doc long, words binary")


class Shard:
    """An FM-index of ``(anchor, seg, doc, words)`` segments, and what streams through it."""

    def __init__(self, held: list[tuple]):
        self.known = Words()
        lists = [self.known.ids(w.split()) for *_, w in held]
        self.words, flat = np.unique(np.concatenate(lists), return_inverse=True)
        self.docs, owner = np.unique(np.array([h[2] for h in held]), return_inverse=True)
        self.index = FmIndex(flat + 1, np.array([len(x) for x in lists]), owner.astype(np.int32), WINDOW)

    def repeats(self, streamed: list[tuple]) -> pa.RecordBatch:
        """``anchor, seg, start, end``: runs of the streamed segments that an indexed one of a smaller document holds."""
        lists = [self.known.ids(w.split()) for *_, w in streamed]
        ids = np.concatenate(lists)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        numbers = np.where(self.words[at] == ids, at + 1, 0)
        before = np.searchsorted(self.docs, np.array([s[2] for s in streamed])).astype(np.int32)
        seq, start, end = self.index.repeats(numbers, np.array([len(x) for x in lists]), before, WINDOW)
        of = lambda i: pa.array(np.array([s[i] for s in streamed], np.int64)[seq])
        return pa.RecordBatch.from_arrays([of(0), of(1), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["anchor", "seg", "start", "end"])


def indexed_repeats(segs: DataFrame, shards: int) -> DataFrame:
    """``anchor, seg, start, end``: runs that a smaller document's segment of the same anchor holds."""
    dealt = segs.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("seg"), F.col("shares")) == F.col("share"))
    rows = dealt.repartition(shards, "anchor", "share").sortWithinPartitions("anchor", "share", F.desc("own"), "doc", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, last = None, [], None
        for batch in batches:
            for anchor, shares, share, own, *rest in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (anchor, share) != last:
                    if waiting and (shard or shares > 1 or len(waiting) >= SHARD_SEGMENTS):
                        yield (shard or Shard(waiting)).repeats(waiting)
                        waiting = []
                    shard = None
                elif not shard and not own and waiting:
                    shard = Shard(waiting)
                if shard and len(waiting) >= SHARD_SEGMENTS:
                    yield shard.repeats(waiting)
                    waiting = []
                last = anchor, share
                if own or shard:  # a share without segments of its own has nothing to find
                    waiting.append((anchor, *rest))
        if waiting:
            yield (shard or Shard(waiting)).repeats(waiting)

    return rows.select("anchor", "shares", "share", "own", "seg", "doc", "words").mapInArrow(run, "anchor long, seg long, start int, end int")


def repeated_places(docs: DataFrame) -> DataFrame:
    """``doc, print, start, end``: runs of words that windows of smaller documents repeat."""
    found = common.written(occurrences(docs), "segments")
    distinct = found.groupBy("anchor", "seg").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    distinct = common.written(distinct, "distinct-segments")
    anchors = common.cut(distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("anchor", "n"))
    shared = common.cut(distinct.join(anchors, "anchor").drop("most"))
    held = found.join(shared, ["anchor", "seg"]).where((F.col("doc") > F.col("least")) | (F.col("n") > 1))
    held = common.written(held, "shared-segments")
    equal = held.where(F.col("doc") > F.col("least")).select("doc", "print", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + WINDOW).alias("end"))
    firsts = held.where((F.col("doc") == F.col("least")) & (F.col("n") > 1))
    needed = firsts.groupBy("anchor", "seg").agg(F.min(F.struct("doc", "print", "first", "windows")).alias("x"), F.max(F.ceil(F.col("n") / SHARD_SEGMENTS).cast("int")).alias("shares")).select("anchor", "shares", "seg", "x.*")
    segs = common.written(segment_words(docs, needed), "segment-words")
    rows = segs.agg(F.sum("shares")).first()[0] or 0
    runs = common.cut(indexed_repeats(segs, max(common.partitions(docs), rows // SHARD_SEGMENTS + 1)))
    places = firsts.select("anchor", "seg", "doc", "print", "first").join(runs, ["anchor", "seg"])
    return equal.unionByName(places.select("doc", "print", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end")))


def remove(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc, print, n_removed, kept``: the texts with places, their other words joined by a space."""
    rows = joined_places(docs, places, ["start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for raw, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = raw.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["end"] for s in spans], -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.nonzero(stays)[0]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "print", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc long, print long, n_removed long, kept binary")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    common.bound_batches(docs.sparkSession)
    changed = common.cut(remove(docs, repeated_places(docs)).select("doc", "print", "n_removed", F.sha2("kept", 256).alias("kept_sha")))
    rows = summaries(docs).join(changed, ["doc", "print"], "left")
    kind = docs.schema["doc_id"].dataType
    return rows.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).cast(kind).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )
