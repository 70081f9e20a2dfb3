"""The pipeline's stages against what the operators say of each document."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from cadenza.llm import langid, secret_scan, toxicity
from cadenza.llm import queries as llm_queries
from cadenza.llm.common import materialize
from cadenza.llm.sql import LICENSES_SQL, SECRETS_SQL

from .conftest import EDGES
from .test_near_duplicates import components, of_five

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialize(stage(spark, docs, SF), name)
        if k < 4:
            assert out.columns == names
        after = {r["doc_id"]: r for r in out.collect()}
        if k == 0:
            assert set(after) == {d for d in before if not predicted[d]}
        elif k == 1:
            kept = {r["doc_id"] for r in langid.identify(langid.from_documents(docs)).collect() if r["kept"]}
            assert set(after) == kept
        elif k == 2:
            sets = {d: of_five(r["text"]) for d, r in before.items()}
            assert set(after) == set(components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]).values())
        elif k == 3:
            assert set(after) == set(before)
            changed = [d for d in before if before[d]["text"] != after[d]["text"]]
            # In these few documents there may be none; hex digits that nothing names stay.
            assert set(changed) == {r["doc_id"] for r in secret_scan.scan(docs).collect() if r["n_live"]}
            assert all("[SECRET]" in after[d]["text"] and after[d]["n_chars"] == len(after[d]["text"]) for d in changed)
        else:
            assert set(after) == set(before)
        docs = out
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edges(spark, edges, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edges, SF)
    assert (out.columns == edges.columns) == (k < 4)
    assert 0 < len(out.collect()) <= max(len(EDGES), 100)
    assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize(("name", "sql"), [("op2_license_scans", LICENSES_SQL), ("op7_secret_scans", SECRETS_SQL)])
def test_queries_with_sql(spark, name, sql):
    df = llm_queries.queries()[name](spark, SF)
    names = df.columns
    got = sorted(tuple(r) for r in df.collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(c.execute(f"select {', '.join(names)} from ({sql})").fetchall())


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_toxicity", "op6_simhash_neardup", "op8_media_columns", "op9_bpe_round_trip", "op10_token_files"):
        assert llm_queries.queries()[name](spark, SF).count() == docs
