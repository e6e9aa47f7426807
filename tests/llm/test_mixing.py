import hashlib
import re

import pytest

from tesseral.llm import mixing


def brute(rows):
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] >= 3 * total[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        order = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, _, x in rows if x == s)
        line = [i for _ in range(3) for _, i in order for _ in range(size[i])][: round(target[s])]
        for _, i in order:
            out[i] = (size[i], total[s], target[s], line.count(i))
    return out


def corpus():
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 4}") for i in range(200)]
    rows += [(1000 + i, "word " * 3000, "hot") for i in range(6)]
    rows += [(2000, None, "empty"), (2001, "", None), (2002, "a\xa0b c\x0bd", None), (2003, "tiny", "Z"), (2004, "two words", "é")]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("n", "n")
    docs = docs.selectExpr("*", "1 AS rank", "2 AS size", "3 AS known", "4 AS target")
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.schedule(docs).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:2] == w[:2] and got[i][3] == w[3] and got[i][2] == pytest.approx(w[2]), (i, got[i], w)


def test_copies_come_in_order_and_are_whole(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    served = mixing.mix(docs)
    assert served.columns == docs.columns
    ids = [r.doc_id for r in served.collect()]
    plan = {r.doc_id: r for r in mixing.schedule(docs).collect()}
    for i, r in plan.items():
        assert ids.count(i) == (round(r.taken / r.size) if r.size else 0) or abs(r.taken / r.size % 1 - 0.5) < 1e-9
    firsts = [plan[i].finish for i in dict.fromkeys(ids)]
    assert firsts == sorted(firsts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.schedule(docs).collect() == [] and mixing.mix(docs).collect() == []


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.schedule(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.mix(docs).collect() == []
