"""Benchmark decontamination, in DataFrame functions only.

A document is contaminated by an item if a window of it, as many words long as the
item (the whole document, if that is shorter), has a weighted similarity of at
least ``similarity`` to the item over shingles of five words: the sum of the smaller
over the sum of the larger multiplicities.

1. Shingles of all documents meet the benchmark's distinct shingles. Only the windows
   that hold enough matched shingles of an item to reach the similarity go on, each with its
   item: this bound is exact, and the best window starts at a matched shingle or ends the document.
2. Windows and items get 64-bit SimHash fingerprints. They are cut into
   ``radius + 1`` blocks; by the pigeonhole principle all pairs within ``radius`` bits
   agree on a block, so an equi-join on (item, block, value) finds every one of them.
3. The exact similarity verifies each pair.
4. Items of fewer than five words are one shingle. The documents' runs of as many words
   meet them in an equi-join of their own; an equal run has a similarity of 1, others of 0.

Windows that reach the similarity differ from the item by about 10 of 64 bits at
0.8 and less above; the default radius of 24 lies five standard deviations beyond. Blocks
for so wide a radius have two or three bits and would select little among all items, so it
is the bound of step 1 that keeps the pairs few; fingerprints rule out others of them.

The benchmark's shingles are broadcast only if, counted, they are few
(``common.BROADCAST_ROWS``); otherwise the join shuffles. The same holds for the hashes of
texts with candidate windows.

Edge cases: null or empty texts and items have no words and match nothing; items of
fewer than five words count wherever their whole sequence stands; texts are
judged by their content, so rows that repeat an id or a text each get their own
result, null ids too; an empty table gives an empty result; other columns pass
through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spaced = F.translate(text, upper + "\t\n\x0b\x0c\r", lower + "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def with_shingles(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``__n_words`` and ``__shingles``, the hashes of runs of ``SHINGLE`` words."""
    def runs(words: Column) -> Column:
        last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
        return F.struct(F.size(words).alias("n"), F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<long>")).alias("shingles"))

    rows = rows.withColumn("__runs", common.once(F.transform(words_of(text), lambda w: F.xxhash64(w)), runs))
    return rows.withColumns({"__n_words": F.col("__runs.n"), "__shingles": F.col("__runs.shingles")}).drop("__runs")


def simhash(shingles: str) -> Column:
    """The 64-bit SimHash of an array of shingle hashes."""
    size = F.size(shingles)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(
            F.when(
                F.aggregate(shingles, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")) * 2 > size,
                F.call_function("shiftleft", F.lit(1).cast("long"), b),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )


def blocks(fingerprint: str, radius: int) -> Column:
    """``radius + 1`` disjoint blocks of a fingerprint, as (number, value)."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])


def numbered(shingles: str) -> Column:
    """An array of hashes in which the copies of a value are told apart by their number, in any order."""
    def told(values: Column) -> Column:
        first = F.transform(values, lambda x, i: F.when((i > 0) & (x == F.get(values, i - 1)), F.lit(0)).otherwise(i))

        def places(first: Column) -> Column:  # a value's first place is the greatest so far
            zipped = F.arrays_zip(values.alias("h"), first.alias("own"), common.running(first, lambda n: n, lambda a, b: F.greatest(a, b)).alias("before"))
            nth = lambda z, i: i - F.greatest(z["own"], z["before"])
            return F.transform(zipped, lambda z, i: F.when(nth(z, i) == 0, z["h"]).otherwise(F.xxhash64(z["h"], nth(z, i))))

        return common.once(first, places)

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.col(shingles)).otherwise(common.once(F.sort_array(shingles), told))


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger multiplicities of two arrays of numbered shingles."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def items_of(benchmark: DataFrame) -> DataFrame:
    """The benchmark's items with their shingles, these numbered, number of words and fingerprint."""
    items = with_shingles(benchmark.select("item_id", "text"), common.text_of("text"))
    items = common.cut(items.select("item_id", F.col("__n_words").alias("n_words"), F.col("__shingles").alias("item")))
    return common.cut(items.where("n_words > 0").withColumns({"item_fp": simhash("item"), "item_told": numbered("item")}))


def candidate_windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``print, item_id, w, start``: the windows with enough matched shingles of an item, by the text's hash."""
    rows = with_shingles(docs.select(F.xxhash64("text").alias("print"), common.text_of("text").alias("text")), F.col("text"))
    rows = rows.select("print", F.size("__shingles").alias("n"), F.posexplode_outer("__shingles").alias("p", "h"))  # outer: else the optimiser tests the array by computing it again
    wanted = common.cut(items.select("item_id", "n_words", F.size("item").alias("m"), F.explode(F.array_distinct("item")).alias("h")))
    known = common.cut(wanted.select("h").distinct())
    met = rows.join(common.maybe_broadcast(known), "h", "left_semi").join(common.maybe_broadcast(wanted), "h")
    places = met.groupBy("print", "n", "item_id", "n_words", "m").agg(F.collect_set("p").alias("at")).withColumn("at", F.sort_array("at"))
    places = places.withColumn("w", F.least("m", "n"))
    # I / (m + w - I) >= similarity needs I shared shingles, at most the matched ones of the window
    need = F.greatest(F.ceil(F.lit(similarity) * (F.col("m") + F.col("w")) / F.lit(1 + similarity) - F.lit(1e-9)).cast("int"), F.lit(1))
    places = places.withColumn("need", need).where(F.size("at") >= F.col("need"))
    enough = lambda p, i: F.get("at", i + F.col("need") - 1) < p + F.col("w")
    starts = F.transform(F.filter("at", enough), lambda p: F.least(p, F.col("n") - F.col("w")))
    return places.select("print", "item_id", "w", F.explode_outer(F.array_distinct(starts)).alias("start")).where("start is not null").distinct()


def short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """The hits of items of fewer than ``SHINGLE`` words, as ``text_hits`` has them; none if there are no such items."""
    short = common.cut(items.where(F.col("n_words") < SHINGLE).select("item_id", "n_words", F.get("item", F.lit(0)).alias("h")))
    sizes = sorted(r["n_words"] for r in short.select("n_words").distinct().collect())
    if not sizes:
        return None
    rows = docs.select(F.xxhash64("text").alias("print"), F.transform(words_of(common.text_of("text")), lambda w: F.xxhash64(w)).alias("words"))

    def runs(n: int) -> Column:
        run = lambda i: F.struct(F.lit(n).alias("n_words"), i.alias("p"), F.xxhash64(*[F.get("words", i + k) for k in range(n)]).alias("h"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), run), lambda x: x["p"] + n <= F.size("words"))

    placed = rows.select("print", F.explode_outer(F.concat(*map(runs, sizes))).alias("x")).select("print", "x.*")
    met = placed.join(common.maybe_broadcast(short), ["n_words", "h"])
    return met.groupBy("print", "item_id").agg(F.min("p").alias("start_word")).withColumn("similarity", F.lit(1.0))


def text_hits(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """``print, item_id, start_word, similarity``: the best window of each pair of a text (its hash) and an item."""
    all_items = items_of(benchmark)
    short, items = short_hits(docs, all_items), all_items.where(F.col("n_words") >= SHINGLE)
    found = common.cut(candidate_windows(docs, items, similarity))
    prints = common.cut(found.select("print").distinct())
    texts = docs.select("text").withColumn("print", F.xxhash64("text")).join(common.maybe_broadcast(prints), "print")
    texts = with_shingles(texts.groupBy("print").agg(F.first("text").alias("text")), F.col("text")).select("print", "__shingles")
    places = found.select("print", "w", "start").distinct()
    windows = common.cut(texts.join(places, "print").select("print", "w", "start", F.slice("__shingles", F.col("start") + 1, F.col("w")).alias("window")))
    windows = common.cut(windows.select("print", "w", "start", simhash("window").alias("fp"), numbered("window").alias("told")))
    fixed = ["print", "item_id", "w", "start"]
    exploded = lambda df, fp: df.withColumn("x", F.explode_outer(blocks(fp, radius))).select("*", "x.block", "x.value").drop("x")
    asked = exploded(windows.select("print", "w", "start", "fp").join(found, ["print", "w", "start"]), "fp")
    indexed = common.cut(exploded(items.select("item_id", "item_fp"), "item_fp"))  # a few numbers a row
    near = asked.join(common.maybe_broadcast(indexed), ["item_id", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*fixed).distinct()
    pairs = near.join(windows.select("print", "w", "start", "told"), ["print", "w", "start"]).join(items.select("item_id", "item_told"), "item_id")
    pairs = pairs.withColumn("similarity", weighted_similarity("told", "item_told")).where(F.col("similarity") >= similarity)
    best = pairs.groupBy("print", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    hits = best.select("print", "item_id", (-F.col("best.start")).alias("start_word"), F.col("best.similarity").alias("similarity"))
    return common.cut(hits if short is None else hits.unionByName(short))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``doc_id, item_id, start_word, similarity`` of every contaminated document and its items."""
    found = text_hits(docs, benchmark, **how)
    return docs.select("doc_id", F.xxhash64("text").alias("print")).join(common.maybe_broadcast(found), "print").drop("print")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no item contaminates."""
    found = common.cut(text_hits(docs, benchmark, **how).select(F.col("print").alias("__print")).distinct())
    rows = docs.withColumn("__print", F.xxhash64("text"))
    return rows.join(common.maybe_broadcast(found), "__print", "left_anti").select(*docs.columns)
