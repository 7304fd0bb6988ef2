"""SimHash near-duplicate classes through a byte-position inverted index.

A fingerprint of 64 bits is 8 positional bytes. Two fingerprints that differ in at
most ``radius`` bits share at least ``8 - radius`` of them. Posting lists go by the byte
values at positions; as a pair misses at most ``radius`` positions, the first ``DEPTH``
that it shares are among ``chosen_positions``, and it meets in one of those lists. In a list
every pair's shared positional bytes are tallied, pairs that reach the guaranteed minimum
are retained, and their bits verified.

A list of over ``LIGHT`` members is not tallied but split by the next position that its
pairs can share, level by level. At the last level a list agrees in ``8 - radius`` bytes, so it
has at most ``2 ** (8 * radius)`` members (65,536 for radius 2), whatever the corpus; its links
are found by looking up flips of the free bits, in time linear in the list. Lists leave
their links as a forest of binary trees, so no fingerprint becomes a hub. Copies share a
fingerprint and are one member. Nothing is capped.

``near_copies`` and ``one_of_each_class`` judge by similarity over shingles of five
words, through an exact prefix index; given a radius, they take the links of this index
first and go on from its classes; see there.

Edge cases: null or empty texts have fingerprint zero and link like any other;
texts with fewer words than a shingle hash their whole sequence; repeated rows
each get their row; a null ``doc_id`` takes part and is never the smallest of a
class unless alone; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Positions by which lists are first formed, and members up to which a list is tallied.
DEPTH, LIGHT = 3, 256
_OFFSETS = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SCALE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 of each run of ``k`` words, joined by a space."""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hash_of = xxhash.xxh64_intdigest
    return [hash_of(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])]


def shingles_of(raw: bytes, k: int) -> Iterator[np.ndarray]:
    """The shingle hashes of a text, part by part; none if it has no words."""
    total, carry = 0, []
    for part in common.parts(raw.translate(LOWER)):
        words = carry + part.split()
        if len(words) >= k:
            found = np.array(shingle_hashes(words, k), np.uint64)
            total += len(found)
            yield found
            carry = words[len(words) - k + 1 :]
        else:
            carry = words
    if not total and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(raw: bytes, k: int = 3) -> int:
    """The SimHash of a text's shingles of ``k`` words."""
    ones, total = np.zeros((8, 8), np.int64), 0
    for found in shingles_of(raw, k):
        places = found.view(np.uint8).reshape(-1, 8) + _OFFSETS
        ones += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        total += len(found)
    return int(_SCALE[(2 * ones.ravel() > total)].sum()) if total else 0


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, print, fp`` of every row: a hash of its text, and the 64 bits as a signed long."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", k) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "print", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, print long, fp long")


# --- the byte-position index -------------------------------------------------------


def chosen_positions(depth: int, radius: int) -> list[tuple[int, ...]]:
    """The first ``depth`` byte positions that a pair sharing all but ``radius`` of the 8 can agree in."""
    return [c for c in combinations(range(8), depth) if c[-1] - depth + 1 <= radius]


def mask_of(positions: tuple[int, ...]) -> int:
    """The mask of the bytes at these positions, as a signed long."""
    mask = sum(0xFF << (8 * i) for i in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def forest(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect each class, as a binary tree: no position is in more than three."""
    order = np.argsort(classes, kind="stable")
    ordered = classes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    nth = np.arange(len(order)) - start
    child = np.nonzero(nth)[0]
    return order[start[child] + (nth[child] - 1) // 2], order[child]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each position's class over the links ``a, b``."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def list_links(members: np.ndarray, radius: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one posting list: pairs of its members.

    Short lists tally the positional bytes that each pair shares and verify the bits of
    the pairs that reach ``8 - radius``. In long ones, which agree in that many bytes anyway,
    every flip of at most ``radius`` of the ``free`` bits is looked up.
    """
    members = np.unique(members.view(np.uint64))
    n = len(members)
    left, right = [], []
    if n <= LIGHT:
        octets = members.view(np.uint8).reshape(n, 8)
        tally = (octets[:, None, :] == octets[None, :, :]).sum(2)
        a, b = np.nonzero(np.triu(tally >= 8 - radius, 1))
        near = np.bitwise_count(members[a] ^ members[b]) <= radius
        left, right = [a[near]], [b[near]]
    else:
        bits = [1 << i for i in range(64) if free >> i & 1]
        for count in range(1, radius + 1):
            for flipped in combinations(bits, count):
                other = members ^ np.uint64(sum(flipped))
                at = np.minimum(np.searchsorted(members, other), n - 1)
                found = np.nonzero((members[at] == other) & (members < other))[0]
                left.append(found)
                right.append(at[found])
    u, v = forest(least_labels(n, np.concatenate(left), np.concatenate(right)))
    return members[u].view(np.int64), members[v].view(np.int64)


def _links_of_lists(lists: DataFrame, free: list[int], radius: int) -> DataFrame:
    """``u, v`` of the posting lists ``choice, members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for choice, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = list_links(members.values.to_numpy(zero_copy_only=False), radius, free[choice])
                u.append(a)
                v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return lists.select("choice", "members").mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v``: links that connect all fingerprints within ``radius`` bits of each other.

    ``distinct`` has one row per fingerprint, in column ``fp``.
    """
    last = 8 - radius
    depth = min(DEPTH, last)
    posted, found = distinct.select("fp"), None
    while True:
        choices = chosen_positions(depth, radius)
        own = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask_of(c))) for c in choices])).alias("choice", "bytes")
        rows = posted.select("fp", own)
        counts = common.cut(rows.groupBy("choice", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
        held = rows.join(common.maybe_broadcast(counts), ["choice", "bytes"])
        ready = held if depth == last else held.where(F.col("n") <= LIGHT)
        lists = ready.groupBy("choice", "bytes").agg(F.collect_list("fp").alias("members"))
        free = [~mask_of(c) & ((1 << 64) - 1) for c in choices]
        made = common.cut(_links_of_lists(lists, free, radius))
        found = made if found is None else found.unionByName(made)
        if depth == last or counts.where(F.col("n") > LIGHT).isEmpty():
            return found.distinct()
        posted = common.cut(held.where(F.col("n") > LIGHT).select("fp").distinct())
        depth += 1


def near_duplicate_classes(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links of ``radius`` bits."""
    prints = common.cut(fingerprints(docs, k))
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp"), radius))
    rooted = common.cut(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    smallest = common.cut(rooted.groupBy("label").agg(F.min("least").alias("component_id")))
    classes = common.cut(rooted.join(smallest, "label").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(column: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


# --- near copies by similarity ---------------------------------------------------
#
# At a similarity of 0.8 over five-word shingles the 64 SimHash bits of two texts differ
# in about 10 places (4 to 18 measured), so no number of equal bytes is guaranteed and
# the index above can't find such pairs. What it links is one class from the start; the
# pairs beyond its radius come from an exact prefix filter: all
# texts order their shingles alike, rare ones first, and post the first
# ``n - ceil(similarity * n) + 1`` of their ``n``. Two texts at ``similarity`` share at least
# ``ceil(similarity * n)`` of either's, so the first they share is posted by both: every
# such pair meets in a list. Pairs that meet are ruled out by bounds or verified.

#: The order counts shingles in about so many texts, one in ``SHARE`` at least, and knows at most so many common ones. It decides
#: how long lists get, not what is found; a sample of fixed size would let them grow with the input.
SAMPLE, SHARE, COMMON = 5_000, 10, 200_000
#: Turns that only link members to the leaders of their block.
LEADER_TURNS = 2
#: Members of a list in one block; a longer list is dealt over blocks, and each two of them meet in the exact turn.
BLOCK = 512
#: Longs of a node's parities; they tell little about sets of over ``LONG_SET`` shingles, which have bucket counts besides.
_WIDTH = 16
LONG_SET = 1_500


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, as signed longs."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles_of(raw, k)])).view(np.int64)


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of a sample of the texts, ascending, and the number of texts that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(_bytes(x), k))], names=["h"])

    share = min(docs.count() // SAMPLE + 1, SHARE)
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0).select(F.col("text").cast("binary").alias("raw"))
    counts = common.cut(sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    least, total = 2, 0
    for n, many in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):  # no more rows than a sample has texts
        total += many
        if total > COMMON:
            least = n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    common.release(counts)
    keys, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(shingles: np.ndarray, keys: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set that it posts, in the order of all texts: by count, then by hash."""
    if not len(shingles):
        return shingles
    n = np.zeros(len(shingles), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        n = np.where(keys[at] == shingles, counts[at], 0)
    most = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1
    return shingles[np.lexsort((shingles, n))[:most]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``64 * _WIDTH`` remainders, a bit: whether an odd number of hashes have it."""
    bits = np.bincount(shingles & (64 * _WIDTH - 1), minlength=64 * _WIDTH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def bucket_counts(shingles: np.ndarray) -> bytes | None:
    """How many hashes of a long set fall to each of about an eighth as many buckets (a power of two), 255 at most."""
    if len(shingles) <= LONG_SET:
        return None
    buckets = 1 << (len(shingles) // 8).bit_length()
    return np.minimum(np.bincount(shingles & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least, by their bucket counts; those of more buckets are folded."""
    one, other = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
    n = min(len(one), len(other))
    return int(np.abs(one.reshape(-1, n).sum(0) - other.reshape(-1, n).sum(0)).sum())


def prefixes(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``doc_id, print, node, size, lists, parity, counts`` of every row: hashes of its text and of its set of shingles, and of the set its size, posting lists, parities and bucket counts."""
    common.bound_batches(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = order.value
        none = np.zeros(0, np.int64)
        for batch in batches:
            nodes, sizes, lists, parity, buckets = [], [], [], [], []
            for x in batch.column(2):
                held = shingle_set(_bytes(x), k)
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED) if len(held) else 0)
                sizes.append(len(held))
                lists.append(prefix(held, keys, counts, similarity))
                parity.append(parities(held))
                buckets.append(bucket_counts(held))
            arrays = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
            arrays += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([none, *x]))) for x in (lists, parity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array(buckets, pa.binary())], names=["doc_id", "print", "node", "size", "lists", "parity", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, print long, node long, size int, lists array<long>, parity array<long>, counts binary")


def distinct_lists(posted: DataFrame) -> DataFrame:
    """``node, value``: the lists of several members; of lists with equal members (by 128 bits of hashes) one."""
    whole = Window.partitionBy("value")  # one exchange of ids; most lists have one member and end here
    hashes = [F.expr(f"bit_xor(xxhash64({i}, node))").over(whole).alias(f"x{i}") for i in (1, 2)]
    several = posted.select("node", "value", F.count("*").over(whole).alias("n"), *hashes).where("n > 1")
    several = common.written(several, "several")
    one = common.cut(several.groupBy("n", "x1", "x2").agg(F.min("value").alias("value")).select("value"))
    found = common.written(several.join(common.maybe_broadcast(one), "value", "left_semi").select("node", "value"), "posted")
    common.release(several, one)
    return found


class Members:
    """The members of posting lists of one Arrow batch, as arrays."""

    def __init__(self, lists: pa.ListArray):
        self.sizes = np.asarray(lists.value_lengths())
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        flat = lists.flatten()
        node, label, size, parity, self.counts = flat.flatten()
        self.node, self.label, self.size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (node, label, size))
        self.parity = parity.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _WIDTH)

    def close(self, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
        """Whether sizes, parities and bucket counts allow members ``a`` and ``b`` (positions) to be similar.

        Two sets differ in at least as many shingles as any of these.
        """
        a, b = np.broadcast_arrays(a, b)
        most = share * (self.size[a] + self.size[b]) + 1e-6
        near = np.abs(self.size[a] - self.size[b]) <= most
        at = np.nonzero(near)[0]
        near[at] = np.bitwise_count(self.parity[a[at]] ^ self.parity[b[at]]).sum(-1) <= most[at]
        for i in np.nonzero(near & (np.minimum(self.size[a], self.size[b]) > LONG_SET))[0]:
            near[i] = least_apart(self.counts[int(a[i])].as_py(), self.counts[int(b[i])].as_py()) <= most[i]
        return near

    def pairs(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """``u, v, from, to`` of members, the lesser node first."""
        turned = self.node[a] > self.node[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        return [self.node[a], self.node[b], self.label[a], self.label[b]]


def _differing(similarity: float) -> float:
    """The part of the sum of two sizes in which sets at ``similarity`` differ at most."""
    return (1 - similarity) / (1 + similarity)


PAIRS = "u long, v long, from long, to long"


def _batch_of(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + c)) for c in columns], names=["u", "v", "from", "to"])


def leader_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """``u, v, from, to``: each member of a block with its leader, if of another class.

    The first member is a leader; those whose bounds allow them to be similar follow it, and the first
    of the others leads next: no member follows more than one.
    """
    share = _differing(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = Members(batch.column(0)), [[], [], [], []]

            def emit(a: np.ndarray, b: np.ndarray) -> None:
                other = held.label[a] != held.label[b]
                for column, values in zip(out, held.pairs(a[other], b[other])):
                    column.append(values)

            two = held.first[:-1][held.sizes == 2]
            near = held.close(two, two + 1, share)
            emit(two[near], two[near] + 1)
            for i in np.nonzero(held.sizes > 2)[0]:
                left = np.arange(held.first[i], held.first[i + 1])
                while len(left) > 1:
                    near = held.close(left[:1], left[1:], share)
                    follow = left[1:][near]
                    emit(np.repeat(left[:1], len(follow)), follow)
                    left = left[1:][~near]
            yield _batch_of(out)

    return blocks.select("members").mapInArrow(run, PAIRS)


def tile_pairs(tiles: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """``u, v, from, to``: all pairs of a block (``whole``) or between two, of different classes, that bounds allow to be similar."""
    share = _differing(similarity)
    names = ["members"] if whole else ["members", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = Members(batch.column(0)), [[], [], [], []]
            for i in range(batch.num_rows):
                left = np.arange(held.first[i], held.first[i + 1])
                both, right = held, left
                if not whole:  # the two blocks in a row
                    both = Members(pa.concat_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)]))
                    left, right = np.arange(both.first[1]), np.arange(both.first[1], both.first[2])
                for at in range(0, len(left), 32):
                    a, b = np.meshgrid(left[at : at + 32], right, indexing="ij")
                    a, b = a.ravel(), b.ravel()
                    kept = (both.label[a] != both.label[b]) & ((a < b) if whole else True)
                    a, b = a[kept], b[kept]
                    near = both.close(a, b, share)
                    for column, values in zip(out, both.pairs(a[near], b[near])):
                        column.append(values)
            yield _batch_of(out)

    return tiles.select(*names).mapInArrow(run, PAIRS)


def blocks_of(placed: DataFrame, sketch: DataFrame) -> DataFrame:
    """``value, own, blocks, members``: each list of ``placed`` (``value, node, label``) dealt over blocks of about ``BLOCK`` members."""
    counts = placed.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("value", "node"), F.col("blocks")).cast("int")
    dealt = placed.join(counts, "value").withColumn("own", own).join(sketch, "node")
    members = F.sort_array(F.collect_list(F.struct("node", "label", "size", "parity", "counts"))).alias("members")
    return dealt.groupBy("value", "own").agg(F.first("blocks").alias("blocks"), members)


def possible_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """``u, v, from, to``: every pair of members of a list in different classes that bounds allow to be similar."""
    inner = tile_pairs(blocks, similarity, True)
    several = blocks.where("blocks > 1")
    left = several.select("value", F.col("own").alias("i"), F.explode(F.sequence(F.col("own") + 1, F.col("blocks"))).alias("j"), "members").where(F.col("j") < F.col("blocks"))
    right = several.where("own > 0").select("value", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("members").alias("others"))
    outer = tile_pairs(left.join(right, ["value", "i", "j"]), similarity, False)
    return inner.unionByName(outer)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``u, v``: links of the classes in ``pairs`` (``u, v, from, to``) whose texts are similar over all their shingles.

    Classes that several pairs link to one are linked as a binary tree.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = common.cut(nodes.select("node", "print").join(wanted, "node"))
    rows = docs.select(F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("raw"))
    texts = common.written(rows.join(common.maybe_broadcast(wanted), "print").groupBy("node").agg(F.first("raw").alias("raw")), "texts")
    # u, which may lead very many pairs, joins last: its pairs stand together
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("raw").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("raw").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5)):
                if u != last:
                    last, left = u, shingle_set(_bytes(a), k)
                right = shingle_set(_bytes(b), k)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared >= similarity * (len(left) + len(right) - shared) - 1e-9)
            kept = np.nonzero(keep)[0]
            one, other = batch.column(2).to_numpy()[kept], batch.column(3).to_numpy()[kept]
            nodes_, at = np.unique(np.concatenate([one, other]), return_inverse=True)
            a, b = forest(least_labels(len(nodes_), at[: len(one)], at[len(one) :])) if len(nodes_) else (at, at)
            yield pa.RecordBatch.from_arrays([pa.array(nodes_[a]), pa.array(nodes_[b])], names=["u", "v"])

    found = common.cut(both.select("u", "v", "from", "to", "a", "b").mapInArrow(run, "u long, v long").distinct())
    common.release(texts, wanted)
    return found


def simhash_classes(docs: DataFrame, prints: DataFrame, radius: int, k: int = 3) -> DataFrame:
    """``node, label``: the classes of nodes by the links of their texts' fingerprints; a node linked to no other may be missing.

    A node can hold texts of several fingerprints (they count repeated shingles), so classes of fingerprints meet in it.
    """
    prints_of = common.cut(fingerprints(docs, k).select("print", "fp").distinct())
    found = components(links(common.cut(prints_of.select("fp").distinct()), radius))
    texts = prints.select("print", "node").distinct().join(prints_of, "print")
    classes = texts.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("label", "fp").alias("class")).distinct()
    classes = common.cut(classes)
    least = common.cut(classes.groupBy("class").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v <> high").drop("high"))
    out = components(classes.join(least, "class").select(F.col("node").alias("u"), "v"))
    common.release(prints_of, classes, least)
    return out


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id, print, node``, and every node's ``node, label``: its class of near copies.

    A node is a set of shingles, so texts that differ in case, white space or repeated
    shingles are one. Given a ``radius``, nodes start in the classes of ``simhash_classes``. The
    first turns only save work: each member of a list is compared with the
    leader of its block, in the second turn one member for each class of a list. The last
    turn is exact: every pair of different classes that a list still holds is ruled out by a
    bound or verified, long lists in tiles of two blocks.
    """
    rows = common.written(prefixes(docs, k, similarity), "prefixes")
    prints = common.written(rows.select("doc_id", "print", "node"), "prints")
    found = rows.groupBy("node").agg(*[F.min("print").alias("print"), *(F.first(c).alias(c) for c in ("size", "lists", "parity", "counts"))])
    found = common.written(found, "sets")
    common.release(rows)
    nodes = common.written(found.drop("lists"), "nodes")
    posted = distinct_lists(found.select("node", F.explode("lists").alias("value")))
    common.release(found)
    sketch = nodes.select("node", "size", "parity", "counts")
    labels = None if radius is None else simhash_classes(docs, prints, radius)
    for turn in range(LEADER_TURNS + 1):
        if labels is None:  # every node is a class
            placed = posted.withColumn("label", F.col("node"))
        else:  # stored, as what follows reads it more than once
            labelled = common.written(posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
            mixed = common.cut(labelled.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("value"))
            placed = labelled.join(common.maybe_broadcast(mixed), "value", "left_semi")
            if turn < LEADER_TURNS:
                placed = placed.groupBy("value", "label").agg(F.min("node").alias("node"))
            placed = common.written(placed, "placed")
            common.release(labelled, mixed)
        blocks = common.written(blocks_of(placed, sketch), "blocks")
        found = leader_pairs(blocks, similarity) if turn < LEADER_TURNS else possible_pairs(blocks, similarity)
        pairs = common.cut(found.distinct())
        common.release(blocks, *([] if labels is None else [placed]))
        met = verified(pairs, nodes, docs, k, similarity)
        if not met.isEmpty():
            merged = components(met)
            if labels is None:
                labels = merged
            else:  # classes of classes; a class that met no other keeps its label
                new = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
                old = labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
                labels = common.cut(old.unionByName(merged.join(labels, "node", "left_anti").select("node", "label")))
        common.release(pairs, met)
    every = nodes.select("node")
    labels = every.withColumn("label", F.col("node")) if labels is None else every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return prints, labels


def one_of_each_class(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each class of near copies: the smallest id, null last, then the least hash of the text.

    Links are similarities and, given a ``radius``, fingerprints within so many bits, as in ``near_duplicate_classes``.
    Rows are told apart by id and text; of rows equal in both one stays. Texts without words are one class.
    """
    last = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    prints, labels = near_copies(docs, k, similarity, radius)
    first = prints.groupBy("node").agg(F.min(last()).alias("first")).join(labels, "node").groupBy("label").agg(F.min("first").alias("first"))
    kept = common.cut(first.select(F.coalesce("first.doc_id", F.lit(0)).alias("__id"), F.col("first.none").alias("__none"), F.col("first.print").alias("__print")))
    keys = ["__id", "__none", "__print"]
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__print": F.xxhash64("text")})
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
