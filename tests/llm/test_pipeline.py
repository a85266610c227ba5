"""Each stage of the pipeline against its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stallkeeper.llm import mixing, queries, simhash
from stallkeeper.staging import staged, table

from ..conftest import DATA


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name], docs = docs, staged(stage(spark, docs, DATA), name)
        if name != "packed":
            assert docs.columns == columns
    kept["end"] = docs
    scores = {r.doc_id: r.score for r in queries.op9_quality(spark, DATA).collect()}
    assert sorted(r.doc_id for r in kept["near_duplicates"].collect()) == sorted(k for k, s in scores.items() if s >= queries.QUALITY)
    groups = {}
    for r in simhash.near_copies(kept["near_duplicates"]).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert sorted(r.doc_id for r in kept["mixture"].collect()) == sorted(map(min, groups.values())) and len(groups) < len(scores)
    mixed = kept["packed"].groupBy("doc_id").count()
    assert mixed.join(kept["mixture"], "doc_id", "left_anti").count() == 0
    texts = {r.doc_id: r.n for r in kept["packed"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    whole = kept["end"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in whole} == set(texts) and all(r.n == r.t * texts[r.doc_id] for r in whole)


def test_mixture_meets_its_targets(spark):
    """At sf0.01, where every domain has documents: the fit meets the targets, and the copies that come out have the shares."""
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    weights = {k: v for k, v in queries.WEIGHTS.items() if k.endswith(" 1")}
    model = queries.domain_model(spark, DATA.replace("0.001", "0.01"), "quality = 1")
    good = staged(simhash.keep_one(docs), "good")
    copies, found = mixing.resample(good, model, weights)
    assert sorted(model.classes) == sorted(weights) and found.met and found.left <= 1e-4 and len(found.steps) < 20
    copies = staged(copies, "copies")
    assert copies.columns == docs.columns
    members = mixing.memberships(copies, model).select("n_tokens", "posteriors").collect()
    total = sum(r.n_tokens * np.array(r.posteriors) for r in members)
    want = np.array([weights[c] for c in model.classes]) / sum(weights.values())
    assert np.abs(total / total.sum() - want).max() < 0.05  # rates are drawn, so shares vary a little


def test_labels_reach_every_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixture", "packed"] and corpus_pipeline.ORACLE_SQL is None
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13
