import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesseral.llm import edits, lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """{(doc_id, line_no): (whether it is repeated, whether it stays)}"""
    at = {(i, k): lines.normal_line(x) for i, t in rows for k, x in enumerate((t or "").split("\n"))}
    at = {k: v for k, v in at.items() if v}
    forms = sorted(set(at.values()))
    keys = [set(r) for r in lines.simhash_blocks(forms).tolist()] if forms else []
    root = list(range(len(forms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(forms):
        for j in range(i):
            if keys[i] & keys[j] and edits.edit_distance(a, forms[j]) * 100 <= 20 * max(len(a), len(forms[j])):
                root[find(i)] = find(j)
    groups = {}
    for place in sorted(at):
        groups.setdefault(find(forms.index(at[place])), []).append(place)
    return {p: (len(g) > 1, p == g[0]) for g in groups.values() for p in g}


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta", "theta", "12", "345", "kappa", "lambda"]
    bases = [[rng.choice(words) for _ in range(n)] for n in (3, 8, 20, 60) for _ in range(4)]
    rows = [(900, None), (901, ""), (902, "\n\n"), (903, "--- *** ---\n"), (904, "page 3 of 10\nPage 4 of 99!"), (905, "long " * 4000), (906, "long " * 4000 + "end")]
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(bases))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            own.append((" " if rng.random() < 0.7 else ", ").join(line))
        rows.append((i, "\n".join(own)))
    return rows


@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b):
    assert edits.edit_distance(a, b) == distance(a, b)


@given(st.lists(st.tuples(st.text("ab", max_size=14), st.text("abc", max_size=14)), max_size=30), st.integers(0, 100))
@settings(max_examples=100, deadline=None)
def test_alike(pairs, apart):
    assert lines.alike(pairs, apart).tolist() == [distance(a, b) * 100 <= apart * max(len(a), len(b)) for a, b in pairs]


def test_many_pairs_together():
    rng = random.Random(1)
    pairs = []
    for n in (1, 5, 63, 64, 65, 130, 200, 400, 1000) * 30:
        a = "".join(rng.choice("abcdé ") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(0, max(2, n // 2))):
            p, what = rng.randrange(len(b) + 1), rng.randrange(3)
            b[p : p + (what > 0)] = [rng.choice("abcz")] if what < 2 else []
        pairs.append((a, "".join(b)))
    most = [rng.randrange(0, 1 + len(a) // 3) for a, _ in pairs]
    assert edits.within(pairs, most).tolist() == [edits.edit_distance(a, b) <= k for (a, b), k in zip(pairs, most, strict=True)]


def test_company_of_ordered_rows():
    rng = random.Random(3)
    rows = sorted((rng.choice((1, 1, 2, 3, rng.randrange(1000))), rng.randrange(12)) for _ in range(400))
    by = {}
    for key, rep in rows:
        by.setdefault(key, set()).add(rep)
    want = [(k, r, min(v)) for k, v in sorted(by.items()) if len(v) > 1 for r in sorted(v)]
    for size in (1, 2, 7, 400):
        batches = [lines.pa.RecordBatch.from_arrays([lines.pa.array([x[k] for x in rows[i : i + size]], lines.pa.int64()) for k in (0, 1)], names=["key", "rep"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in lines._company(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BYTES", 400)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("root", F.lit(1))
    want = brute(rows)
    got = {(r.doc_id, r.line_no): (True, r.kept) for r in lines.duplicate_lines(docs).collect()}
    assert got == {p: x for p, x in want.items() if x[0]}
    summary = {r.doc_id: r for r in lines.summary(docs).collect()}
    assert summary.keys() == {i for i, _ in rows}
    for i, text in rows:
        r = summary[i]
        gone = [k for (d, k), (again, kept) in sorted(want.items()) if d == i and again and not kept]
        assert r.n_lines == (len(text.split("\n")) if text else 0)
        assert r.dropped == ",".join(map(str, gone)) and r.n_dropped == len(gone)
    left = {r.doc_id: r for r in lines.drop_duplicate_lines(docs).collect()}
    for i, text in rows:
        gone = set(map(int, filter(None, summary[i].dropped.split(","))))
        assert left[i].text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        assert left[i].line == "clash"


def test_near_hashes_share_a_block():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    found = 0
    for _ in range(50):
        line = [words[i] for i in rng.integers(0, 400, 60)]
        other = [*line[:30], "changed", *line[31:]]
        a, b = lines.simhash_blocks([" ".join(line), " ".join(other)])
        found += bool(set(a.tolist()) & set(b.tolist()))
    assert found >= 25


def test_majority_bits():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(700)]
    texts = [" ".join(words[:n]) for n in (0, 1, 2, 3, 50, 255, 256, 700)]
    data, offsets = lines.raw_bytes(lines.pa.array(texts))
    starts, ends, at = lines.words_of(data, offsets)
    hashes = lines.segment_hashes(data, starts, ends)
    got = lines._majority(hashes, at, lines.stream64(2, 1))
    for i in range(len(texts)):
        bits = np.unpackbits(lines.mix64(hashes[at[i] : at[i + 1]][:, None] ^ lines.stream64(2, 1)).view(np.uint8), axis=1, bitorder="little")
        want = np.packbits(2 * bits.sum(axis=0) > len(bits), bitorder="little").view(np.uint64) if len(bits) else np.zeros(2, np.uint64)
        assert (got[i] == want).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.summary(docs).collect() == [] and lines.drop_duplicate_lines(docs).collect() == []


def edited(seed, share, many):
    """Pairs of lines: the second with words replaced at random, as many as stay within `share` percent of edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11)))
    out = []
    while len(out) < many:
        line = [word() for _ in range(rng.choice((10, 15, 20, 30, 50)))]
        other = list(line)
        for k in rng.sample(range(len(line)), len(line)):
            more = [*other[:k], word(), *other[k + 1 :]]
            if distance(" ".join(line), " ".join(more)) * 100 > share * max(len(" ".join(line)), len(" ".join(more))):
                break
            other = more
        if other != line:
            out.append((" ".join(line), " ".join(other)))
    return out


def test_recall_against_edit_distance_alone(spark):
    """Lines within the threshold by edit distance, whatever keys they share."""
    for share, least in ((10, 0.98), (20, 0.95)):
        pairs = edited(share, share, 60)
        rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
        got = {r.doc_id for r in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect()}
        assert got <= {2 * i + 1 for i in range(len(pairs))} and len(got) >= least * len(pairs)


def test_keys_do_not_depend_on_the_other_lines():
    texts = ["", "a", "abcd", "é" * 9, "one two three", "word " * 3000, "the last line of all"]
    whole = lines.simhash_blocks(texts)
    assert whole.shape == (len(texts), lines.KEYS)
    for i, text in enumerate(texts):
        assert (lines.simhash_blocks([text])[0] == whole[i]).all()


def test_rows_that_repeat(spark):
    rows = [(1, "one line of text here\nanother"), (1, "short"), (1, "one line of text here\nanother"), (2, "one line of text here"), (None, "short"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_repeated, r.dropped) for r in lines.summary(docs).collect())
    assert got == [(-1, 1, 0, ""), (1, 1, 0, ""), (1, 2, 2, ""), (1, 2, 2, ""), (2, 1, 1, "0"), (3, 0, 0, "")]
    assert sorted((r.doc_id or -1, r.text or "") for r in lines.drop_duplicate_lines(docs).collect()) == sorted((i or -1, "" if i == 2 else t or "") for i, t in rows)


def test_distances_up_to_a_limit():
    rng = random.Random(5)
    for n in (0, 1, 31, 32, 33, 64, 150):
        for _ in range(60):
            a = "".join(rng.choice("abc") for _ in range(n))
            b = list(a)
            for _ in range(rng.randrange(0, 40)):
                p, what = rng.randrange(len(b) + 1), rng.randrange(3)
                b[p : p + (what > 0)] = [rng.choice("abc")] if what < 2 else []
            b = "".join(b) if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randrange(150)))
            d = distance(a, b)
            assert all(edits.at_most(a, b, k) == (d <= k) for k in {0, max(0, d - 1), d, d + 1, rng.randrange(150)})


def test_packed_keys_give_the_members_of_each_key():
    rng = random.Random(7)
    rows = [(i % 37, [rng.choice((5, -8, rng.randrange(-(1 << 46), 1 << 46))) for _ in range(lines.KEYS)]) for i in range(90)]
    blocks = [b"".join((k % (1 << 48)).to_bytes(6, "little") for k in keys) for _, keys in rows]
    batch = lines.pa.RecordBatch.from_arrays([lines.pa.array([r for r, _ in rows], lines.pa.int64()), lines.pa.array(blocks, lines.pa.binary())], names=["line", "blocks"])
    by = {}
    for rep, keys in rows:
        for k in keys:
            by.setdefault(k % (1 << 48), set()).add(rep)
    want = sorted((k, r, min(v)) for k, v in by.items() if len(v) > 1 for r in v)
    dealt = sorted((x for b in lines._dealt(8)(iter([batch.slice(0, 50), batch.slice(50)])) for x in b.to_pylist()), key=lambda x: x["part"])
    parts = lines.pa.RecordBatch.from_pylist(dealt, schema=lines.pa.schema([("part", lines.pa.int32()), ("keys", lines.pa.binary())]))
    got = sorted(tuple(r.values()) for b in lines._company(lines._ordered(iter([parts.slice(0, 3), parts.slice(3)]))) for r in b.to_pylist())
    assert got == want


def test_unrelated_lines_of_common_words_are_rarely_candidates():
    """Lines that begin and end alike and have the same short words, but nothing else in common."""
    rng = random.Random(9)
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    texts = ["of the " + " ".join(rare() + " of the" for _ in range(12)) for _ in range(60)]
    keys = lines.simhash_blocks(texts)
    shared = sum(bool((keys[i] == keys[j]).any()) for i in range(60) for j in range(i))
    assert shared < 0.05 * 60 * 59 / 2


def test_some_long_pairs_are_compared_together(monkeypatch):
    """A hundred pairs of several hundred characters need no table of their own, and limits around the distance decide alike."""
    rng = random.Random(11)
    pairs, most = [], []
    for n in [rng.randrange(65, 700) for _ in range(100)]:
        a = "".join(rng.choice("abcdefgh é漢") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(1, max(2, n // 3))):
            p, what = rng.randrange(len(b) + 1), rng.randrange(3)
            b[p : p + (what > 0)] = [rng.choice("abcz")] if what < 2 else []
        pairs.append((a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice("abcdefgh ") for _ in range(n))))
        most.append(max(0, edits.edit_distance(*pairs[-1]) + rng.choice((-40, -1, 0, 1, 40))))
    want = [edits.edit_distance(a, b) <= k for (a, b), k in zip(pairs, most, strict=True)]
    alone = []
    monkeypatch.setattr(edits, "at_most", lambda a, b, k: alone.append(a) or edits.edit_distance(a, b) <= k)
    assert edits.within(pairs, most).tolist() == want
    assert len(alone) <= 10


def test_places_give_the_first_of_each_line():
    rng = random.Random(13)
    rows = [(rng.choice((3, -4, rng.randrange(-99, 99))), rng.randrange(-3, 3), rng.randrange(-2, 2), rng.randrange(3)) for _ in range(300)]
    types = [lines.pa.int64()] * 3 + [lines.pa.int32()]
    batches = [lines.pa.RecordBatch.from_arrays([lines.pa.array([r[k] for r in rows[i : i + 70]], types[k]) for k in range(4)], names=["line", "doc_id", "row", "line_no"]) for i in range(0, 300, 70)]
    dealt = sorted((x for b in lines._places(8)(iter(batches)) for x in b.to_pylist()), key=lambda x: x["part"])
    parts = lines.pa.RecordBatch.from_pylist(dealt, schema=lines.pa.schema([("part", lines.pa.int32()), ("keys", lines.pa.binary())]))
    got = sorted(tuple(r.values()) for b in lines._forms(iter([parts.slice(0, 3), parts.slice(3)])) for r in b.to_pylist())
    assert got == sorted((x, *min(r[1:] for r in rows if r[0] == x), sum(r[0] == x for r in rows)) for x in {r[0] for r in rows})


def test_word_hashes_are_those_of_segments():
    rng = random.Random(17)
    for sizes in ([], [1], [64, 1, 63], [65, 2], [rng.randrange(1, 70) for _ in range(9000)], [rng.randrange(1, 65) for _ in range(9000)]):
        data, offsets = lines.raw_bytes(lines.pa.array([" ".join("".join(chr(rng.randrange(33, 127)) for _ in range(n)) for n in sizes)]))
        starts, ends, _ = lines.words_of(data, offsets)
        assert len(starts) == len(sizes) and (lines._word_hashes(data, starts, ends) == lines.segment_hashes(data, starts, ends, seed=31)).all()
