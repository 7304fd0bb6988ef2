"""Substring dedup against a search of all windows, and the FM-index against plain search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import docs_of


def brute(rows, window=50):
    """``(n_words, n_removed, kept_sha256)`` of each (doc_id, text)."""
    first = {}
    lists = [(t or "").encode().split() for _, t in rows]
    last = 1 << 70
    for (d, _), words in zip(rows, lists):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, last + 1), last if d is None else d)
    out = []
    for (d, _), words in zip(rows, lists):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (last if d is None else d):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_fm_index_finds_all_runs():
    from meshweave.llm.fm_index import FmIndex

    rng = np.random.default_rng(1)
    for least in (1, 3, 5):
        base = rng.integers(1, 4, 40)
        lists = [np.concatenate([rng.integers(1, 5, int(rng.integers(0, 6))), base[i : i + int(rng.integers(1, 20))], rng.integers(1, 5, 3)]) for i in rng.integers(0, 30, 25)]
        owner = rng.integers(0, 12, 25).astype(np.int32)
        flat, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
        seq, start, end = FmIndex(flat, sizes, owner, 64).repeats(flat, sizes, owner, least)
        got = [np.zeros(len(x), bool) for x in lists]
        for s, a, b in zip(seq, start, end):
            got[s][a:b] = True
        for i, x in enumerate(lists):
            want = np.zeros(len(x), bool)
            for a in range(len(x) - least + 1):
                if any(owner[j] < owner[i] and any((lists[j][b : b + least] == x[a : a + least]).all() for b in range(len(lists[j]) - least + 1)) for j in range(25)):
                    want[a : a + least] = True
            assert (want == got[i]).all()


@pytest.mark.parametrize("most", [12_000, 2])
def test_equals_all_windows(spark, monkeypatch, most):
    from meshweave.llm import substring

    monkeypatch.setattr(substring, "SHARD_SEGMENTS", most)
    rng = np.random.default_rng(4)
    pick = lambda n: [f"v{x}" for x in rng.integers(0, 500, n)]
    passage, base = pick(70), pick(300)
    texts = [None, "", "short", " ".join(["of"] * 120), " ".join(["of"] * 75)]
    for i in range(30):
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(300))] = f"edit{i}"
        texts.append(" ".join(words if i % 3 == 0 else pick(int(rng.integers(0, 90))) + passage[: int(rng.integers(45, 71))] + pick(int(rng.integers(0, 90)))))
    texts += [texts[5], "\n".join(base), " \t".join(passage), " ".join(passage * 3)]
    ids = [int(x) for x in rng.permutation(len(texts))]
    rows = [*zip(ids, texts), (ids[7], texts[7]), (ids[8], " ".join(base[50:200])), (None, " ".join(base))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, print string").repartition(3)
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(docs).collect())))
    want = sorted(map(str, ((d, *x) for (d, _), x in zip(rows, brute(rows)))))
    assert got == want
    assert substring.substring_dedup(docs.where(F.lit(False))).count() == 0
