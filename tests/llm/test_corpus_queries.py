import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_minhash import brute as near
from test_mixing import brute as mixed

import corpus_pipeline
from tesseral.llm import decontam, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """The rows of a query, which is run once."""
    done = {}

    def run(name):
        if name not in done:
            df = queries.QUERIES[name](spark, SF)
            done[name] = (df.columns, df.collect())
        return done[name]

    return run


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(rows, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).to_df()
    got = pd.DataFrame(rows(name)[1], columns=rows(name)[0])
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want.columns:
        a, b = (x.sort_values("doc_id")[c].to_numpy() for x in (got, want))
        assert np.allclose(a, b) if a.dtype.kind == "f" else (a == b).all(), c


def test_near_duplicates_of_the_table(rows, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows("op2_minhash")[1]}
    assert got == near([(i, r.text) for i, r in docs.items()])


def contaminated(documents):
    """The ids that the SQL, which knows no spaced seeds, finds among (doc_id, text) rows."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(documents, columns=["doc_id", "text"]))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return {i for i, found, *_ in con.sql(decontam.ORACLE_SQL).fetchall() if found}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each_document_or_page(spark, rows, docs, name):
    ids = [r[0] for r in rows(name)[1]]
    want = set(docs) if name != "op4_html" else {r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_pages_of_the_table(spark, rows):
    """The article of each page by its known markup."""
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows("op4_html")[1]:
        source = pages[r.page_id].html or ""
        inside = source.partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pipeline_stage_by_stage(spark, docs):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        kept = stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        rows = kept.collect()
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            known = [i for i in labels if i in docs]
            assert sum((i in gone) == bool(labels[i]) for i in known) >= 0.95 * len(known)
        elif name == "near_dedup":
            want = near([(r.doc_id, r.text) for r in before], 5)
            assert {r.doc_id for r in rows} == {i for i, x in want.items() if x[2]}
        elif name == "decontaminate":
            bad = contaminated([(r.doc_id, r.text) for r in before])
            assert bad
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - bad
        elif name == "mix":
            want = mixed([(r.doc_id, r.text, r.source) for r in before])
            many = {i: sum(r.doc_id == i for r in rows) for i in want}
            assert all(abs(many[i] * size - taken) <= size / 2 for i, (size, _, _, taken) in want.items())
        if name != "shard":
            assert sorted(kept.columns) == sorted(columns) and all(r.text == docs[r.doc_id].text for r in rows)
        else:
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            assert len({(r.shard, r.slot) for r in rows}) == len(rows) and {r.shard for r in rows} == set(range(8))


def test_pipeline_of_a_table(spark, rows):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert hashlib.sha256(b"").hexdigest() == next(r.base_sha256 for r in rows("op9_secrets")[1] if not r.spans)
