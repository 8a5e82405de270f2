"""The registered queries against their SQL, and the pipeline's stages against plain re-statements."""

from __future__ import annotations

import duckdb
import pytest
from compare import check, duck, mismatch
from llm_cases import awkward_texts, contamination, frame, kept_words
from test_llm_operators import fingerprint, smallest_reachable

import corpus_pipeline
from edaflux.llm import queries, toxicity
from edaflux.llm.frames import stored


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_llm_query_matches_sql(spark, sf_dir, name):
    _, _, diff, kinds = check(spark, duck(sf_dir), sf_dir, name, queries.QUERIES[name], queries.SQL[name])
    assert not diff, diff
    assert {k: v for k, v in kinds.items() if mismatch(*v)} == {}


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark", "mixture"]


def test_stages_take_effect(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    items = [tuple(r) for r in queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    seen = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir))
        seen[name] = docs.collect()
        if name != "mixture":
            assert docs.columns == before.columns and docs.schema == before.schema
    pairs = lambda name: [(r["doc_id"], r["text"]) for r in seen[name]]
    # Only rows go in the first two stages; only texts change in the next two.
    assert set(pairs("near_duplicates")) <= set(pairs("toxicity")) <= set(pairs("start"))
    scores = toxicity.toxicity(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")).collect()
    assert {d for d, _ in pairs("toxicity")} == {r["doc_id"] for r in scores if r["predicted"] == 0}
    ids, texts = zip(*pairs("toxicity"), strict=True)
    assert sorted(d for d, _ in pairs("near_duplicates")) == sorted(set(smallest_reachable([fingerprint(t) for t in texts], ids)))
    for a, b in (("near_duplicates", "repeated_passages"), ("repeated_passages", "benchmark")):
        assert {d for d, _ in pairs(a)} == {d for d, _ in pairs(b)}
        assert all(r["n_chars"] == len(r["text"]) for r in seen[b])
    removed = {r[0]: r[2] for r in kept_words(pairs("near_duplicates"), 50)}
    left = {d: len(t.split()) for d, t in pairs("repeated_passages")}
    assert all(left[d] == len(t.split()) - removed[d] for d, t in pairs("near_duplicates"))
    hit = {r[0] for r in contamination(pairs("repeated_passages"), items) if r[5]}
    changed = {d for d, t in pairs("benchmark") if dict(pairs("repeated_passages"))[d] != t}
    assert changed == hit
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(seen["benchmark"], docs_schema(spark, sf_dir)).toPandas())
    want = con.execute(f"SELECT doc_id, epoch FROM ({queries.OP2_SQL})").fetchall()
    assert sorted((r["doc_id"], r["epoch"]) for r in seen["mixture"]) == sorted(want)
    assert {"epoch", "n_tokens", "domain"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen["mixture"])


def docs_schema(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents").schema


def test_stages_of_awkward_and_no_documents(spark, sf_dir):
    """Names that the last stage adds are taken already, ids are null or repeated, texts empty; and a table without rows."""
    awkward = frame(spark, awkward_texts())
    for docs in (awkward.withColumnsRenamed({"key": "domain", "spans": "epoch"}), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stored(stage(spark, docs, sf_dir))
            if name != "mixture":
                assert docs.schema == before.schema
        assert set(before.columns) | {"domain", "epoch", "n_tokens"} == set(docs.columns)
        assert dict(docs.dtypes)["epoch"] == "int"  # of columns that share a name, the stage's own stays
