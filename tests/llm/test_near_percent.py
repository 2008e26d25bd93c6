"""The near-duplicate stage at its own threshold."""

from __future__ import annotations

import corpus_pipeline
from overgrid.llm import near
from tests.llm import brute


def test_the_stage_drops_what_the_query_keeps(spark):
    words = [f"w{k}" for k in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:180], *(f"x{k}" for k in range(20))]), 3: " ".join([*words[:160], *(f"y{k}" for k in range(40))])}
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= like(1, 2) < 0.85 and max(like(1, 3), like(2, 3)) < 0.8
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in near.near_components(docs).collect() if r.kept} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 3}
    assert near.band_width(85) == 5 and near.band_width(80) == 4
