import itertools
import random
import re

from pyspark.sql import functions as F

from tesseral.llm import decontam


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """All (doc_id, item_id, start, length, agreeing) by trying each window of each diagonal, without any seeds."""
    out = set()
    for d, text in docs:
        ours = split(text)
        for i, item in items:
            theirs = split(item)
            need = min(decontam.LEAST, len(theirs))
            percent = decontam.AGREE if len(theirs) >= decontam.SPAN else 100
            for diagonal in range(-len(theirs), len(ours)) if theirs else ():
                low, high = max(0, -diagonal), min(len(theirs), len(ours) - diagonal)
                same = [ours[diagonal + p] == theirs[p] for p in range(low, high)]
                found = [
                    (s, s + n)
                    for s in range(len(same))
                    for n in range(need, min(2 * need - 1, len(same) - s) + 1)
                    if 100 * sum(same[s : s + n]) >= percent * n
                ]
                if found:
                    start, end = min(s for s, _ in found), max(e for _, e in found)
                    out.add((d, i, diagonal + low + start, end - start, sum(same[start:end])))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "Ünder"]
    item = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, item(n)) for k, n in enumerate((9, 12, 15, 25, 40, 60))]
    docs = [(900, None), (901, ""), (902, "... !!"), (903, "one two")]
    for d in range(60):
        text = item(rng.randrange(0, 80))
        if d % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "substituted"
            if d % 5 == 0:
                part = part[: len(part) // 2]
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    items = [(k, " ".join(w).upper()) for k, w in items] + [(100, None), (101, ""), (102, "w3 w4"), (103, "Not, there."), (104, "W7"), (5000, " ".join(items[2][1]))]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit("x")).withColumn("item_id", F.lit(3)).withColumn("words", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(rows, items)
    assert len(want) > 20 and any(x[3] != x[4] for x in want)
    for at_once in (200_000, 37):
        monkeypatch.setattr(decontam, "SEEDS_AT_ONCE", at_once)
        monkeypatch.setattr(decontam, "BITMAP_WORDS", 64)
        assert {tuple(r) for r in decontam.overlaps(docs, benchmark).collect()} == want
    bad = {x[0] for x in want}
    got = {r.doc_id: r for r in decontam.contamination(docs, benchmark).collect()}
    assert got.keys() == {d for d, _ in rows}
    for d, r in got.items():
        ids = sorted({x[1] for x in want if x[0] == d})
        assert r.contaminated == (d in bad) and r.n_items == len(ids) and r.items == ",".join(map(str, ids))
    kept = decontam.drop_contaminated(docs, benchmark)
    assert set(kept.columns) == set(docs.columns) and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - bad


def test_a_very_long_text_and_many_copies(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " * 60_000 + passage)] + [(i, passage) for i in range(2, 300)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = decontam.overlaps(docs, benchmark).collect()
    assert len(got) == 299 and {r.length for r in got} == {30}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(docs, none).collect()] == [(1, False, 0, "")]
    assert decontam.contamination(docs.limit(0), none).collect() == []


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_masks_hit_whatever_fifth_is_substituted():
    looked = [[k for k, bit in enumerate(m) if bit == "1"] for m in decontam.MASKS]
    # other lengths up to 25 hold one of these with no more substitutions; longer ones fall in two halves
    for length in (9, 10, 11, 12, 13, 15, 20, 25):
        for gone in map(set, itertools.combinations(range(length), length * (100 - decontam.AGREE) // 100)):
            assert any(all(p + k not in gone for k in m) for m in looked for p in range(length - decontam.SPAN + 1))


def test_substitutions_up_to_the_limit_are_found(spark):
    rows, items = [], []
    for i, gone in enumerate(itertools.combinations(range(13), 2)):
        own = [f"i{i}w{k}" for k in range(13)]
        items.append((i, " ".join(own)))
        rows.append((i, " ".join(["before"] * 20 + ["other" if k in gone else w for k, w in enumerate(own)] + ["after"] * 20)))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id for r in decontam.contamination(docs, benchmark).where("contaminated").collect()}
    assert got == {i for i, _ in rows}


def test_runs_parted_by_a_replaced_middle_are_found(spark):
    cuts = ((59, 19, 39), (40, 14, 26), (30, 13, 30), (60, 0, 47))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, (n, _, _) in enumerate(cuts)]
    rows = [(i, " ".join(["x"] * 7 + [f"y{k}" if a <= k < b else f"i{i}w{k}" for k in range(n)] + ["z"] * 7)) for i, (n, a, b) in enumerate(cuts)]
    rows += [(10, " ".join([f"i0w{k}" if k < 10 or k >= 49 else f"y{k}" for k in range(59)]))]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.overlaps(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(4)}
    # a row goes from its diagonal's first window to its last; the items are found with what was replaced in between
    assert {r.doc_id: (r.start - 7, r.length, r.agreeing) for r in got} == {0: (0, 59, 39), 1: (0, 40, 28), 2: (0, 16, 13), 3: (44, 16, 13)}


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Seven little words that nobody else has"), (2, "One more item of eight tokens in all")]
    rows = [(1, "x y seven little words, that nobody else has z"), (2, "seven little words that someone else has"), (3, "One more item of eight tokens in all"), (4, "one more item of eight")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontam.overlaps(docs, benchmark).collect()} == {(1, 1, 2, 7, 7), (3, 2, 0, 8, 8)}


def test_rows_that_repeat_and_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (1, "clean text"), (1, passage), (None, passage), (None, "clean"), (2, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage), (None, passage), (7, passage)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.contaminated, r.n_items, r.items) for r in decontam.contamination(docs, benchmark).collect())
    assert got == [(-1, False, 0, ""), (-1, True, 1, "7"), (1, False, 0, ""), (1, True, 1, "7"), (1, True, 1, "7"), (2, False, 0, "")]
    assert sorted((r.doc_id or -1, r.text) for r in decontam.drop_contaminated(docs, benchmark).collect() if r.text) == [(-1, "clean"), (1, "clean text")]


def test_recall_of_random_windows(spark):
    """Windows of 13 to 40 tokens with up to a fifth substituted, anywhere in an item and a document."""
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(60))) for i in range(120)]
    rows = []
    for i in range(120):
        n = rng.randrange(13, 41)
        at = rng.randrange(0, 60 - n)
        gone = set(rng.sample(range(n), n // 5))
        part = ["other" if k in gone else f"i{i}w{at + k}" for k in range(n)]
        rows.append((i, " ".join(["filler"] * rng.randrange(0, 30) + part + ["after"] * rng.randrange(0, 30))))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(docs, benchmark).where("contaminated").collect()} == set(range(120))
