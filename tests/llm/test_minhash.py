import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import minhash
from tesseral.llm.common import shingle_sets


def brute(rows, k=2, percent=80):
    sets = {}
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "GAMMA", "delta", "épée", "zeta", "eta", "theta", "iota", "kappa"]
    bases = [[rng.choice(words) + str(rng.randrange(40)) for _ in range(n)] for n in (3, 12, 40, 90, 300)]
    texts = [None, "", "  \t\n", "one", "One", "one two", "ONE\x0btwo", "one two one two", "a" * 50_000, "x " * 9000, "\xa0 nbsp", "nbsp"]
    for base in bases:
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.7 else "\n\t").join(copy))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_matches_brute_force(spark, shingle):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    assert result(minhash.near_duplicates(docs, shingle=shingle)) == brute(rows, shingle)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []
    assert minhash.drop_near_duplicates(docs).collect() == []


def test_open_buckets_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs, shingle=2)) == brute(rows)


def test_estimate_is_unbiased_and_stopping_early_changes_nothing():
    import pyarrow as pa

    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(200, 1200))
    sets = list(shingle_sets(pa.array([a, b]), 1))
    together = minhash.super_minhash(sets)
    apart = np.vstack([minhash.super_minhash([s]) for s in sets])
    assert np.array_equal(together, apart)
    assert abs((together[0] == together[1]).mean() - 800 / 1200) < 0.12
    assert np.isfinite(minhash.super_minhash([sets[0][:1]])).all()
