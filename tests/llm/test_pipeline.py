"""The pipeline's stages against what they should keep."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from corpus_pipeline import STAGES, run

    rng = np.random.default_rng(9)
    vocab = ["word%d" % i for i in range(300)]
    pick = lambda n: " ".join(rng.choice(vocab, n))
    items = [pick(20) for _ in range(3)]
    texts = [pick(60) + "." for _ in range(60)]
    junk = [" ".join(w + "***" for w in pick(60).split()) for _ in range(12)]
    copies = [texts[0], texts[0].upper(), "  ".join(texts[1].split())]
    leaks = [pick(30) + " " + items[0] + " " + pick(20), items[2]]
    private = [pick(40) + " mail some.one@host.org " + pick(5)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, *junk, *copies, *leaks, *private])]
    sf = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 72), 0) for i in range(0, 78)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = len(rows)
    kept = []
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")], name
        docs = spark.createDataFrame(docs.collect(), columns)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, dedup, clean, redacted = kept
    assert not set(quality) & set(range(60, 72)) and len(quality) >= n - 12 - 2
    assert set(quality) - set(dedup) <= {72, 73, 74} and len({0, 72, 73} & set(dedup)) == len({0, 72, 73} & set(quality)) - len({0, 72, 73} & set(quality) - {0}) or 0 not in quality
    assert set(dedup) - set(clean) == {75, 76} & set(dedup)
    assert all(redacted[i] == clean[i] for i in redacted if i != 77) and "[EMAIL]" in redacted.get(77, "[EMAIL]")
    out = run(spark, sf)
    assert {"shard", "slot", "turn", "first_word", "n_words_taken", "doc_id", "text"} <= set(out.columns)
    assert {r["doc_id"] for r in out.collect()} <= set(redacted)


def test_near_dedup_takes_simhash_links(spark):
    """Texts within 2 bits of SimHash are one class, and so is what either kind of link joins to it."""
    from corpus_pipeline import drop_near_duplicates
    from meshweave.llm.simhash import fingerprint, one_of_each_class

    rng = np.random.default_rng(5)
    pick = lambda n: " ".join("u%d" % x for x in rng.integers(0, 10**9, n))
    tail = pick(60)
    texts = [
        "a b c " * 200 + pick(30),  # the same print as the next, but few shared shingles
        "a b c " * 200 + tail,
        "a b c " * 5 + tail,  # the set of shingles of the one before, another print
        "a b c " * 5 + tail + " end",  # similar to the one before
        *(pick(40) for _ in range(20)),
    ]
    prints = [fingerprint(t.encode()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < min((prints[1] ^ prints[i]).bit_count() for i in range(2, 24))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = lambda found: sorted(r["doc_id"] for r in found.collect())
    assert kept(one_of_each_class(docs)) == [0, 1, *range(4, 24)]
    assert kept(drop_near_duplicates(spark, docs, "")) == [0, *range(4, 24)]
    assert kept(drop_near_duplicates(spark, docs.where("doc_id > 4"), "")) == [*range(5, 24)]
    assert kept(drop_near_duplicates(spark, docs.where("false"), "")) == []


def test_order_of_shingles_counts_a_share_of_texts(spark, monkeypatch):
    """A passage that one in twenty texts holds is known as common however many texts there are."""
    from meshweave.llm import simhash

    passages = [" ".join("p%dw%d" % (i, j) for j in range(20)) for i in range(20)]
    rows = [(i, "own%d here " % i + passages[i % 20]) for i in range(2000)]
    monkeypatch.setattr(simhash, "SAMPLE", 10)
    keys, _ = simhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert {int(h) for p in passages for h in simhash.shingle_set(p.encode(), 5)} <= set(keys.tolist())
