import random

import numpy as np
from pyspark.sql import functions as F

from tesseral.llm import chunks
from tesseral.llm.common import stream64


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def bounds(text):
    """The chunks by moving the gear hash on byte by byte."""
    gear = (stream64(256, 1234) >> np.uint64(32)).astype(int).tolist()
    data, ends, start = text.encode(), [], 0
    for i in range(len(data)):
        h = sum(gear[data[i - k]] << k for k in range(min(chunks.WINDOW, i + 1))) & 0xFFFFFFFF
        whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        if whole and (h >> (chunks.WINDOW - 1)) % (1 << chunks.MASK_BITS) == 0 and i + 1 - start >= chunks.LEAST:
            ends.append(i + 1)
            start = i + 1
        elif i + 1 - start > chunks.MOST:
            cut = start + chunks.MOST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            start = cut
    return ends + [len(data)] * (start < len(data))


def test_bounds_match_a_rolling_hash():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 5, 300)] + ["é" * 700, "a" * 900, "\U0001f600" * 300]
    for text in texts:
        assert chunks.chunk_bounds(np.frombuffer(text.encode(), np.uint8)) == bounds(text), text[:50]


def test_an_insertion_shifts_few_chunks():
    rng = random.Random(2)
    text = prose(rng, 2000)
    other = text[:3000] + "inserted here" + text[3000:]
    cut = lambda t: [t.encode()[a:b] for a, b in zip([0, *bounds(t)], bounds(t), strict=False)]
    a, b = cut(text), cut(other)
    assert len(set(a) & set(b)) > 0.95 * len(set(a))


def brute(rows):
    places, where = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        ends = bounds(text or "")
        where[i] = list(zip([0, *ends], ends, strict=False))
        for k, (a, b) in enumerate(where[i]):
            places.setdefault(data[a:b], []).append((i, k))
    out = {}
    for i, text in rows:
        data, runs = (text or "").encode(), []
        for k, (a, b) in enumerate(where[i]):
            at = places[data[a:b]]
            if len(at) > 1:
                goes = at[0] != (i, k)
                if runs and runs[-1][1] == a and runs[-1][3] == goes:
                    runs[-1][1:3] = [b, runs[-1][2] + 1]
                else:
                    runs.append([a, b, 1, goes])
        runs = [r for r in runs if r[1] - r[0] >= chunks.PASSAGE]
        gone = [r for r in runs if r[3]]
        out[i] = (len(where[i]), len(data), sum(r[2] for r in runs), sum(r[2] for r in gone), sum(r[1] - r[0] for r in gone), ",".join(f"{a}:{b}" for a, b, *_ in gone))
    return out


def corpus():
    rng = random.Random(4)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = [(900, None), (901, ""), (902, "x"), (903, "a" * 3000), (904, prose(rng, 8000))]
    for i in range(60):
        text = prose(rng, rng.randrange(3, 120))
        if i % 2:
            text = f"{prose(rng, 20)} {rng.choice(shared)} {text}"
        rows.append((i, text))
    return rows + [(200 + i, rows[20][1]) for i in range(30)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("chunk", F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in chunks.passages(docs).collect()}
    want = brute(rows)
    assert got == want
    # every later copy of a passage of 60 words is met, and nothing else
    meets = [i for i, _ in rows if i < 60 and i % 2]
    assert all(want[i][2] for i in meets) and not any(want[i][2] for i, _ in rows if i < 60 and i % 2 == 0 and i != 15)
    left = {r.doc_id: r.text for r in chunks.drop_repeated_passages(docs).collect()}
    for i, text in rows:
        data = (text or "").encode()
        for a, b in reversed([tuple(map(int, s.split(":"))) for s in want[i][5].split(",") if s]):
            data = data[:a] + data[b:]
        assert left[i] == (None if text is None else data.decode())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunks.passages(docs).collect() == [] and chunks.drop_repeated_passages(docs).collect() == []


def test_rows_that_repeat(spark):
    rng = random.Random(7)
    passage, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, passage), (1, "short"), (1, passage), (2, f"{prose(rng, 30)} {passage}"), (2, other), (3, other), (None, passage), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed > 0) for r in chunks.passages(docs).collect())
    size = lambda t: len((t or "").encode())
    assert got == sorted((i or -1, size(t), (i == 2 and t != other) or i == 3) for i, t in rows)
    left = chunks.drop_repeated_passages(docs).collect()
    assert len(left) == len(rows) and sum(r.text == passage for r in left) == 3
