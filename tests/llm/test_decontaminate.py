"""Benchmark decontamination against a search of all windows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from .test_operators import docs_of


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(text, item):
    """The best weighted similarity of an item-sized window."""
    a, b = shingles(lowered(text)), shingles(lowered(item))
    if not a or not b:
        return 0.0
    w, best = min(len(a), len(b)), 0.0
    want = Counter(b)
    for s in range(len(a) - w + 1):
        have = Counter(a[s : s + w])
        both = sum((have & want).values())
        best = max(best, both / (w + len(b) - both))
    return best


def test_equals_all_windows(spark):
    from meshweave.llm.decontaminate import clean, contaminated

    rng = np.random.default_rng(2)
    vocab = ["V%d" % i for i in range(60)]
    pick = lambda n: [str(x) for x in rng.choice(vocab, n)]
    items = [" ".join(pick(n)) for n in (14, 20, 37, 37, 59, 3)] + ["a b " * 12, None, ""]
    texts = [None, "", "short text"]
    for i, item in enumerate(items[:7] * 6):
        words = item.split()
        for _ in range(int(rng.integers(0, 2))):
            words[int(rng.integers(len(words)))] = "changed"
        if i % 5 == 0:
            words.insert(len(words) // 2, "inserted")
        texts.append(" ".join(pick(int(rng.integers(0, 40))) + words + pick(int(rng.integers(0, 40)))).upper().replace(" ", "\n" if i % 2 else "  "))
    texts += [items[2], " ".join(items[2].split()[:33]), " ".join(items[2].split()[5:]), texts[3], items[5], *(" ".join(pick(50)) for _ in range(10))]
    docs = docs_of(spark, texts).withColumn("print", F.lit("clash"))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = {(d, i): brute(t, item) for d, t in enumerate(texts) for i, item in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 0.8 - 1e-12}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(docs, benchmark).collect()}
    assert got.keys() == want.keys() and len(got) > 12
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert contaminated(docs.where(F.lit(False)), benchmark).count() == 0 == contaminated(docs, benchmark.where(F.lit(False))).count()


def test_short_items_inside_documents(spark):
    """Items of one to four words, against all windows of as many words."""
    from meshweave.llm.decontaminate import clean, contaminated

    rng = np.random.default_rng(8)
    vocab = ["V%d" % i for i in range(9)]
    pick = lambda n: " ".join(rng.choice(vocab, n))
    items = ["lone", "V1 V2", "V3 v4 V5", "V1 V2 V3 V4", "V1 V1 V1 V1", "V2\tV2", None, "", pick(20)]
    texts = [None, "", "lone", "v1", "V1 V2", "v3 V4 v5 v6 v1 v2 v3 V4", pick(60) + " LONE", items[8] + " x", *(pick(int(n)) for n in rng.integers(1, 90, 30))]
    docs = docs_of(spark, texts)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items[:6]):
            words, wanted = lowered(text), lowered(item)
            starts = [s for s in range(len(words) - len(wanted) + 1) if words[s : s + len(wanted)] == wanted]
            if starts:
                want[d, i] = (starts[0], 1.0)
    want[7, 8] = (0, 1.0)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in contaminated(docs, benchmark).collect()}
    assert got == want and len({i for _, i in want}) > 5  # items of each length
    assert {r["doc_id"] for r in clean(docs, benchmark).collect()} == set(range(len(texts))) - {d for d, _ in want}
