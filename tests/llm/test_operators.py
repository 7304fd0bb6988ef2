"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return (text or "").encode().split()


# --- 1 mixing -------------------------------------------------------------


def test_targets_stop_at_twice_the_source():
    from meshweave.llm.mixing import targets

    got = targets([100, 10, 0, 50], [3, 1, 2, 3], Fraction(3, 2), Fraction(2))
    assert sum(got) == 240 and got[1] == 20 and got[2] == 0 and all(t <= 2 * n for t, n in zip(got, [100, 10, 0, 50]))


def test_splitting_tree_keeps_quotas():
    from meshweave.llm.mixing import split

    tree = split(np.array([1000, 7, 0, 300]), 13, np.random.default_rng(1))
    assert tree.sum(0).tolist() == [1000, 7, 0, 300] and (tree >= 0).all()
    assert tree.sum(1).max() - tree.sum(1).min() <= 2


def test_permutation_is_one():
    from meshweave.llm.mixing import permuted

    for n in (1, 2, 3, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mixing_comes_near_targets(spark):
    from meshweave.llm.mixing import mix, taken_words

    rng = np.random.default_rng(0)
    texts = [None, "", *(" ".join(["w%d" % i for i in range(n)]) for n in rng.integers(1, 400, 120)), "a " * 9000]
    sources = [[None, "a", "b", "c"][int(x)] for x in rng.integers(0, 4, len(texts))]
    docs = docs_of(spark, texts, sources)
    rows = taken_words(docs).collect()
    again = taken_words(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(70, 0.01 * t)
    mixed = mix(docs).collect()
    assert Counter() + taken == sum((Counter({sources[r["doc_id"]]: r["n_words_taken"]}) for r in mixed), Counter())
    for r in mixed:
        assert words(r["text"]) == words(texts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words_taken"]]
    assert taken_words(docs.limit(0)).count() == 0
    # every pass takes a word of a document at most once, a whole pass takes all of them
    size, passes = Counter(), {}
    for r in rows:
        size[sources[r["doc_id"]]] += r["size"]
    for r in rows:
        for p in r["by_shard"]:
            got = passes.setdefault((r["doc_id"], p["turn"]), Counter())
            got.update(range(p["first_word"], p["first_word"] + p["words"]))
        assert r["taken"] == sum(p["words"] for p in r["by_shard"])
        for turn in range(int(r["target"] // max(1, r["source_size"]))):
            assert r["size"] == len(passes.get((r["doc_id"], turn), ()))
        assert r["source_size"] == size[sources[r["doc_id"]]]
    assert all(set(c.values()) == {1} for c in passes.values())
    pieces = lambda r: sorted((p["shard"], p["turn"], p["first_word"], p["words"]) for p in r["by_shard"])
    made = defaultdict(list)
    for r in mixed:
        made[r["doc_id"]].append((r["shard"], r["turn"], r["first_word"], r["n_words_taken"]))
    assert all(pieces(r) == sorted(made[r["doc_id"]]) for r in rows)


def test_mixing_deals_shards_by_the_tree(spark, monkeypatch):
    from meshweave.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 3_000)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    docs = docs_of(spark, ["w " * n for n in range(1, 150)], ["ab"[n % 2] for n in range(1, 150)])
    sources, shards = mixing.recipe([("a", sum(range(2, 150, 2))), ("b", sum(range(1, 150, 2)))], 17)
    words = Counter()
    for r in mixing.taken_words(docs).collect():
        for p in r["by_shard"]:
            words["ab"[(r["doc_id"] + 1) % 2], p["shard"]] += p["words"]
    assert shards == 6
    for s in sources:
        block = s.size / s.blocks
        for shard, draws in enumerate(np.diff(s.owned)):
            assert abs(words[s.name, shard] - draws * block) <= 2 * block + draws


def test_mixing_takes_any_rows(spark):
    from meshweave.llm.mixing import mix, taken_words

    rows = [(None, "a b c", None), (None, "a b d", None), (7, "same text", "x"), (7, "same text", "x"), (7, "other words", "x"), (8, None, None), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "size", "start", "pieces", "group", "order", "bucket", "x", "shard", "target")])
    out = mix(clash)
    assert set(out.columns) == set(clash.columns) | {"slot", "turn", "first_word", "n_words_taken"} and {r["size"] for r in out.collect()} == {1}
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, mix(docs.repartition(3)).collect()))
    assert taken_words(docs).count() == len(rows)
    long = mix(docs_of(spark, ["word " * 400_000]))  # in time proportional to the text
    assert long.agg(F.sum("n_words_taken")).first()[0] == 600_000


# --- 2 top-k ----------------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_topk_equals_brute_force(spark, scale):
    from meshweave.llm.topk import exact_topk, quantised

    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(330, 6)), 1) * scale
    vecs[50:120] = vecs[0]  # many ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vecs)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 6), (700, []), (None, [1.0] * 6)]
    q = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = defaultdict(list)
    for r in exact_topk(q.where("id % 100 = 0"), q).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    ints = [[int(np.floor(1024 * x)) for x in v] for v in vecs.tolist()]
    for i in range(0, 330, 100):
        want = sorted(((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in range(330) if j != i))[:10]
        if scale == 1.0:
            assert got[i] == [(j, -s, k + 1) for k, (s, j) in enumerate(want)]
    assert set(got) == {0, 100, 200, 300}


# --- 3 token counts -----------------------------------------------------------


def test_token_counts_equal_the_library(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from meshweave.llm import common, token_counts

    monkeypatch.setattr(common, "PART_BYTES", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", " \n", "Hello's <|endoftext|> it's<|startoftext|>X", "á ́b\x1c c 1234abc ÄÖ ΑΣ σ", "word " * 400, "9" * 300, "x" * 70_000, "12ab" * 30_000, "\U0001f600" * 50]
    library = Tokenizer.from_file(path)
    texts += [texts[3], "word " + "y" * 100 + " word"]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert len(got) == len(texts) and token_counts.token_counts(docs_of(spark, texts).limit(0), path).count() == 0
    other = public_tokenizers.path("byte_bpe_50k.json")  # white space counts: whole texts
    library = Tokenizer.from_file(other)
    for r in token_counts.token_counts(docs_of(spark, texts), other).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)


# --- 4 WARC -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    from meshweave.llm.warc import archive, read_back

    html = [None, "", "<p>é</p>", "same", "same", "x" * 3_000_000, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    rows = [(i, "http://h/ä b\n" if i else None, h, "extra") for i, h in enumerate(html)]
    index = archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2))
    got = {r["page_id"]: r for r in read_back(index).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        same = [j for j, x in enumerate(html) if (x or "") == (h or "")]
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == max(same) else ("revisit", max(same)))
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == raw
    assert archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reads_large_payloads_in_small_batches(spark, monkeypatch):
    from meshweave.llm import common, warc

    rows = [(i, "http://h/", "%d " % i + "x" * 5000) for i in range(40)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).toArrow().select(["archive", "offset", "length"])
    monkeypatch.setattr(common, "ARROW_BYTES", 20_000)
    got = list(warc.members(iter(index.combine_chunks().to_batches()), True))
    assert max(b.num_rows for b in got) <= 4
    assert sorted((r["page_id"], r["payload"].decode()) for b in got for r in b.to_pylist()) == [(r[0], r[2]) for r in rows]
    bare = list(warc.members(iter(index.combine_chunks().to_batches()), False))
    assert "payload" not in bare[0].schema.names and sum(b.num_rows for b in bare) == 40


# --- 8 toxicity -----------------------------------------------------------------------


def test_toxicity_held_out(spark):
    from meshweave.llm.toxicity import toxicity

    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(400)]
    texts, toxic = [], []
    for _ in range(800):
        ws = list(rng.choice(vocab, 40))
        bad = rng.random() < 0.2
        if bad:
            ws[:3] = rng.choice(["vile", "rotten", "nasty"], 3)
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    texts += [None, ""]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity(docs_of(spark, texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 800]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.95
    none = toxicity(docs_of(spark, texts), labels.limit(0)).collect()
    assert len(none) == len(texts) and len({r["score"] for r in none}) == 1


# --- 9 quality -----------------------------------------------------------------------


def test_quality_keeps_good_and_exact_k(spark):
    from meshweave.llm.quality import Selector, kth_largest

    rng = np.random.default_rng(6)
    vocab = ["w%d" % i for i in range(200)]
    good = [" ".join(rng.choice(vocab, 60)) + "." for _ in range(300)]
    junk = [" ".join(w + "***" for w in rng.choice(vocab, 60)) for _ in range(60)]
    docs = docs_of(spark, [*good, *junk, None, ""])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)], "doc_id long, quality int, toxic int")
    chosen = Selector(docs, labels)
    kept = {r["doc_id"] for r in chosen.select(docs).collect()}
    assert chosen.select(docs).columns == docs.columns
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(300, 360))
    assert kept == {r["doc_id"] for r in chosen.scores().where("kept").collect()} and len(kept) == chosen.k
    fixed = Selector(docs, labels, k=37)
    assert fixed.select(docs).count() == 37
    keys = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(rng.integers(0, 9, 500))], "doc_id long, key double")
    clash = docs.select("*", *[F.lit(c).alias(c) for c in ("raw", "key", "log_weight", "n_grams", "row", "per_gram")])
    out = chosen.select(clash)
    assert out.columns == clash.columns and {tuple(r[c] for c in ("raw", "key", "row")) for r in out.collect()} == {("raw", "key", "row")}
    long = docs_of(spark, [good[0] * 20_000, None, "", *good[:40]])
    assert set(range(3, 43)) <= {r["doc_id"] for r in chosen.select(long).collect()}
    assert Selector(long.unionAll(long), labels).scores().count() == 86  # repeated rows, a long text
    value, last, _ = kth_largest(keys, 123)
    want = sorted(keys.collect(), key=lambda r: (-r["key"], r["doc_id"]))[122]
    assert (value, last) == (want["key"], want["doc_id"])
    assert Selector(docs.limit(0), labels).scores().count() == 0
    assert Selector(docs, labels.where("quality = 0")).select(docs).count() == docs.count()


def test_quality_equals_brute_force(spark):
    """Log weights of both models and the k largest keys, from plain counts."""
    from meshweave.llm import quality

    rng = np.random.default_rng(16)
    vocab = ["w%d" % i for i in range(50)]
    texts = [None, "", *(" ".join(rng.choice(vocab, int(rng.integers(1, 30)))) + "." for _ in range(80)), "x*** y" * 5]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    chosen = quality.Selector(docs, labels, k=20)
    slots = [[int(x) for part in quality.Hasher().slots((t or "").encode()) for x in part] for t in texts]
    model = lambda ids: Counter(x for i in ids for x in slots[i])
    target, raw = model(i for i in range(40) if i % 3), model(range(len(texts)))
    of = lambda c, x: (c[x] + 0.5) / (sum(c.values()) + 0.5 * quality.SLOTS)
    rows = {r["doc_id"]: r for r in chosen.scores().collect()}
    for i, own in enumerate(slots):
        assert rows[i]["n_grams"] == len(own) and rows[i]["log_weight"] == pytest.approx(sum(np.log(of(target, x) / of(raw, x)) for x in own), abs=1e-6)
    best = sorted(rows, key=lambda i: -rows[i]["key"])[:20]
    assert {i for i in rows if rows[i]["kept"]} == set(best)
    noise = [rows[i]["key"] - rows[i]["log_weight"] for i in rows]
    assert 0 < np.mean(noise) < 1.2 and 0.8 < np.std(noise) < 1.8  # Gumbel: 0.58 and 1.28


# --- 10 SimHash -----------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(monkeypatch):
    from meshweave.llm import common, simhash

    monkeypatch.setattr(common, "PART_BYTES", 30)
    for text in ("", " ", "One", "One two", "ÀB c D", "a b c " * 50, "the cat sat on the mat and left\n\x0bnow"):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_classes(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("light", [256, 3])
def test_classes_equal_brute_force(spark, monkeypatch, light):
    from meshweave.llm import simhash
    from meshweave.llm.components import components

    monkeypatch.setattr(simhash, "LIGHT", light)
    rng = np.random.default_rng(7)
    prints = [0]
    for _ in range(700):
        base = prints[int(rng.integers(len(prints)))] if rng.random() < 0.7 else int(rng.integers(1 << 63)) * 2 + 1
        prints.append(base ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, int(rng.integers(0, 4))), initial=0)))
    distinct = sorted(set(prints))
    want = brute_classes(distinct, 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in distinct], "fp long"), 2)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    got = [label.get(signed(x), signed(x)) for x in distinct]
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_long_posting_list():
    from meshweave.llm.simhash import list_links

    rng = np.random.default_rng(8)
    members = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64))
    u, v = list_links(members.view(np.int64), 2, 0xFFFF)
    label = {int(m): int(m) for m in members}
    for a, b in sorted(zip(u, v)):  # the lesser end of a tree's link comes first
        label[int(b)] = label[int(a)]
    few = members[:1500]
    pairs = {tuple(sorted((int(a), int(b)))) for a in few for b in few[np.bitwise_count(few ^ a) <= 2] if a != b}
    assert len(pairs) > 1000 and all(label[a] == label[b] for a, b in pairs)
    assert max(np.unique(np.concatenate([u, v]), return_counts=True)[1]) <= 3


def test_near_duplicate_classes(spark):
    from meshweave.llm.simhash import fingerprint_text, near_duplicate_classes

    texts = ["a b c d", "A  b\nc D", None, "", "other words here now", "a b c d", "one"]
    rows = near_duplicate_classes(docs_of(spark, texts)).select("doc_id", fingerprint_text().alias("f"), "component_id").collect()
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_classes(prints, 2)
    assert sorted((r["doc_id"], r["f"], r["component_id"]) for r in rows) == [(i, f"{prints[i]:016x}", want[i]) for i in range(len(texts))]
    assert near_duplicate_classes(docs_of(spark, texts).where(F.lit(False))).count() == 0


def brute_copies(texts, k=5, similarity=0.8):
    def shingles(text):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared and shared >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    from meshweave.llm import common, simhash

    rng = np.random.default_rng(12)
    vocab = ["w%d" % i for i in range(500)]
    texts = [None, "", " ", "one", "One", "two words", "two  words", "five words are here now", "five words are here Now x"]
    shared = " ".join(rng.choice(vocab, 60))
    for _ in range(12):  # groups of edited copies, some beyond the limit; a passage many share
        base = list(rng.choice(vocab, int(rng.integers(20, 200))))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 2 + len(base) // 30))):
                copy[at] = "edit%d" % rng.integers(1000)
            texts.append(" ".join(copy))
        texts.append(" ".join(rng.choice(vocab, 50)) + " " + shared)
    texts += texts[20:25]
    docs = docs_of(spark, texts)
    want = brute_copies(texts)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    kept = simhash.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert len(set(want)) < len(texts) - 20
    assert simhash.one_of_each_class(docs.where(F.lit(False))).count() == 0
    twice = docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["doc_id"] for r in simhash.one_of_each_class(twice.unionAll(twice)).collect()] == [None]


def test_bounds_never_exceed_the_difference():
    from meshweave.llm.simhash import bucket_counts, least_apart

    rng = np.random.default_rng(3)
    for n, m, shared in ((2000, 2000, 1900), (1600, 9000, 1000), (5000, 4000, 0), (40_000, 39_000, 20_000)):
        a, b = (np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, x)) for x in (n, m))
        b[: min(shared, len(a))] = a[:shared]
        apart = len(np.setxor1d(a, b))
        assert apart / 6 < least_apart(bucket_counts(a), bucket_counts(b)) <= apart
        assert least_apart(bucket_counts(a), bucket_counts(a)) == 0
    assert bucket_counts(a[:100]) is None


def test_near_copies_in_hot_lists(spark, monkeypatch):
    """Hundreds of texts below the limit around one passage, with pairs among them, and stars of edited copies."""
    from meshweave.llm import simhash

    rng = np.random.default_rng(21)
    pick = lambda n: ["u%d" % x for x in rng.integers(0, 10**9, n)]
    passage, texts = pick(240), []
    for i in range(300):
        own = pick(40)
        texts.append(" ".join(passage + own))
        if i % 10 == 0:  # of the pair's 40 own words some differ
            texts.append(" ".join(passage + own[: int(rng.integers(8, 30))] + pick(15)))
    for _ in range(3):  # copies are within the limit of the hub only
        hub = pick(200)
        texts.append(" ".join(hub))
        for _ in range(60):
            copy = list(hub)
            for at in rng.choice(np.arange(5, 195, 6), 3, replace=False):
                copy[at] = pick(1)[0]
            texts.append(" ".join(copy))
    base = pick(3000)  # long sets: near copies, halves shared, one of another size
    for shared in (3000, 2900, 2700, 1500, 1400, 200):
        texts.append(" ".join(base[:shared] + pick(3000 - shared)))
    texts.append(" ".join(base[:2500]))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    want = brute_copies(texts)
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    got = simhash.one_of_each_class(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))
    assert 250 < len(set(want)) < len(texts) - 180
