import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import toxicity

INSULTS = ["idiot", "stupid", "moron", "pathetic", "scum", "worthless"]
SYLLABLES = "th er an in on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def prose(rng, n, insults=()):
    words = [word(rng) for _ in range(n)]
    for x in insults:
        words.insert(rng.randrange(len(words) + 1), x)
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9))


def corpus(seed, n=400):
    rng = random.Random(seed)
    return [(prose(rng, rng.randrange(5, 120), [rng.choice(INSULTS) for _ in range(rng.randrange(1, 4))] if bad else ()), bad) for bad in (rng.random() < 0.3 for _ in range(n))]


@pytest.fixture(scope="module")
def model():
    return toxicity.train(corpus(1))


def predicted(model, texts):
    return model.probability(toxicity.decide_texts(model, texts)) >= 0.5


def test_held_out_accuracy(model):
    rows = corpus(2, 600)
    right = predicted(model, [t for t, _ in rows]) == np.array([bad for _, bad in rows])
    assert right.mean() > 0.98


def test_gapped_and_inserted_characters(model):
    rng = random.Random(5)
    for bad in INSULTS:
        forms = [bad.upper(), ".".join(bad), "-".join(bad), " ".join(bad), bad + "!!!", f"({bad})", bad[:2] + "*" + bad[2:], bad[0] * 2 + bad[1:], bad[:3] + "x" + bad[3:], bad + "s"]
        texts = [prose(rng, 30) + f" {f} " + prose(rng, 30) for f in forms]
        assert predicted(model, texts).mean() >= 0.8, (bad, list(zip(forms, predicted(model, texts), strict=True)))


def test_the_kernel_is_the_sum_over_common_subsequences():
    def direct(a, b):
        def feats(s):
            out, room = {}, 0.0
            for i in range(len(s)):
                for places, w in toxicity.PATTERNS:
                    if i + places[-1] < len(s):
                        key = (s[i], *(s[i + p] for p in places))
                        out[key] = out.get(key, 0) + w
                        room += w * w
            return out, room

        (x, nx), (y, ny) = feats(a), feats(b)
        return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(nx * ny)

    marks = ["\x01idiot\x01", "\x01worthless\x01", "\x01abababab\x01"]
    who, what, weight = toxicity.occurrences(marks)
    used, inverse = np.unique(what, return_inverse=True)
    column = np.full(toxicity.THREES + toxicity.FOURS, -1)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used), len(marks)))
    np.add.at(table, (inverse, who), weight)
    words = ["\x01idxiot\x01", "\x01worth\x01", "\x01babab\x01"]
    got = toxicity._kernel(words, table, column)
    assert np.allclose(got, [[direct(w, m) for m in marks] for w in words])


def test_scores_of_a_table(spark, model):
    long = prose(random.Random(3), 40_000)
    rows = [(1, None), (2, ""), (3, "\n\t"), (4, "you idiot"), (5, long), (6, long + " moron"), (6, "moron"), (7, "1 2 ;"), (8, "\U0001f600 ퟿")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    high = {i for i, s in got if s >= 0.5}
    assert high == {4, 6}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 7, 8}


def test_training_from_tables(spark):
    rows = [(i, t, int(bad)) for i, (t, bad) in enumerate(corpus(4))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (10**9, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    again = toxicity.fit_toxicity(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(got[i] == bool(b) for i, _, b in rows) > 0.98 * len(rows)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, none) is None and toxicity.fit_toxicity(docs, one) is None
    assert [r.score for r in toxicity.score_toxicity(docs, None).collect()] == [0.0]
    assert toxicity.drop_toxic(docs, None).count() == 1
    assert toxicity.score_toxicity(docs.limit(0), None).collect() == []


def test_held_out_rule(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
