"""Nulls in every column, clashing names, repeated rows: nothing crashes and each case has its result."""

import pytest

import corpus_pipeline
from tesseral.llm import chunks, decontam, exact, lines, minhash, mixing, pages, queries, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, root long, digest string, node int, size int, line string"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (None, None, None, None, None),
    (None, LONG, "en", "s", 1),
    (None, LONG, None, "s", 1),
    (1, LONG, "en", None, 1),
    (2, LONG + " more", "en", "s", None),
    (3, None, "en", "s", 0),
    (4, "", None, "", 0),
    (5, "idiot\n" * 3 + "password=abcdef12", "en", "s", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + (7, 7, "x", 7, 7, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, LONG), (2, None), (None, LONG)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (5, None, 1), (1, 1, 0), (2, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    page = "<article><p>text</p></article>"
    spark.createDataFrame([(None, None, None), (None, "http://a.example/x", page), (1, None, page), (2, "http://a.example/x", None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_every_row(spark, folder, name):
    want = spark.read.parquet(f"{folder}/{'pages' if name == 'op4_html' else 'documents'}.parquet").count()
    assert len(queries.QUERIES[name](spark, folder).collect()) == want


def test_filters_keep_rows_without_an_id(spark, docs, folder):
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())
    near = ids(minhash.drop_near_duplicates(docs))
    assert near.count((False, 0)) == 3 and (True, 1) in near and (True, 2) not in near
    clean = ids(decontam.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))
    assert clean.count((False, 0)) == 1 and (True, 1) not in clean  # two of the rows without an id hold the passage
    assert lines.drop_duplicate_lines(docs).count() == chunks.drop_repeated_passages(docs).count() == len(ROWS)
    served = mixing.mix(docs)
    assert served.columns == docs.columns and ids(served).count((False, 0)) == 3
    assert sharding.kd_shards(docs, shards=3).count() == len(ROWS)
    assert secrets.mask(docs, None).where("text like '%[SECRET]%'").count() == 1
    assert toxicity.drop_toxic(docs, None).count() == len(ROWS)


def test_exact_groups_without_an_id(spark, docs, tmp_path):
    got = exact.deduplicate(docs, exact.DigestIndex(spark, str(tmp_path / "i"), 2)).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == len(ROWS) and sorted(r.doc_id for r in kept) == [1, 2, 4, 5]


def test_rows_that_repeat(spark):
    again = spark.createDataFrame([(1, LONG, "en", "s")] * 3 + [(2, LONG, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r.component_id for r in minhash.near_duplicates(again).collect()] == [1] * 4
    assert mixing.schedule(again).count() == sharding.kd_shards(again, shards=2).count() == 4
    assert secrets.scan(again, None).count() == 4
    model = toxicity.train([("you idiot", True), ("total idiot you are", True), ("fine words here", False), ("a clean day", False)] * 3)
    scores = {(r.doc_id, r.score) for r in toxicity.score_toxicity(again.union(again), model).collect()}
    assert len(scores) == 2


def test_exact_copies_under_one_id(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "A"), (None, "b"), (None, "b")]
    got = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), exact.DigestIndex(spark, str(tmp_path / "again"), 2)).collect()
    assert len(got) == len(rows) and {r.group_size for r in got} == {3}
    assert {r.keep_id for r in got if r.text_sha256 == exact_digest("a")} == {2}


def exact_digest(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_an_id_with_both_labels_is_toxic(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine words here") for i in range(20)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(20)] + [(1, 0), (3, 0)]
    one = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = toxicity.fit_toxicity(docs, spark.createDataFrame([x for x in labels if x not in ((1, 0), (3, 0))], "doc_id long, toxic int"))
    assert one.offset == two.offset and (one.weights == two.weights).all()


def test_a_pipeline_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

def test_pages_without_an_id(spark, folder):
    got = sorted(r.text for r in pages.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect())
    assert got == ["", "", "text", "text"]


def test_pipeline(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    # what holds the benchmark's passage goes, with or without an id; texts without words are served no time
    assert [(r.doc_id, r.size, r.shard, r.slot) for r in found] == [(None, 1, 0, 0)]
