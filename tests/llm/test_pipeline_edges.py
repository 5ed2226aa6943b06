"""Null texts and ids, repeated rows, clashing columns and empty tables through all pipeline stages; toxicity against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from microstar.llm import toxicity
from microstar.llm.common import written
from tests.conftest import SF_SMALL
from tests.llm.helpers import EDGES, docs, empty


def test_stages_take_edge_rows(spark):
    before = written(docs(spark, EDGES), "edges")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF_SMALL), f"edge-{name}")
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        have = Counter(r.doc_id for r in before.select("doc_id").collect())
        if name in ("toxicity", "near_dedup"):
            assert not ids - have
        if name == "secrets":
            assert ids == have
        if name != "encode":
            assert after.columns == columns
        before = after
    assert before.where("NOT library_agrees").count() == 0


def test_stages_take_empty_tables(spark):
    before = written(empty(docs(spark, EDGES)), "none")
    for name, stage in corpus_pipeline.STAGES:
        before = written(stage(spark, before, SF_SMALL), f"none-{name}")
        assert before.count() == 0, name


def test_counts_ratios_and_scores_equal_a_plain_version(spark):
    """Document counts of n-grams per class, their log ratios and the score sum, by dictionaries."""
    settings = toxicity.Settings(sizes=(3,), features=64, rounds=200)
    texts = [("you are vile scum", 1), ("vile scum get out", 1), ("scum and vile words", 1), ("a fine day out", 0), ("the day was fine", 0),
             ("words of the day", 0), ("", 0), (None, 0), ("fine fine fine", 0), ("scummy day", 1)]
    rows = [(i, t) for i, (t, _) in enumerate(texts * 6)]
    label = {i: texts[i % len(texts)][1] for i, _ in rows}
    labels = spark.createDataFrame([(i, 0, label[i]) for i, _ in rows], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    model = toxicity.train(table, labels, settings=settings)
    import zlib
    trained = [(i, t or "") for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    totals = Counter(label[i] for i, _ in trained)
    seen = {0: Counter(), 1: Counter()}
    for i, t in trained:
        _, found = toxicity.grams([t], settings)
        padded = f" {t.lower()} "
        distinct = {padded[k:k + n] for n in settings.sizes for k in range(len(padded) - n + 1)}
        assert len(set(found.tolist())) == len(found) == len(distinct)  # a bucket a gram: none of these few collide
        seen[label[i]].update(found.tolist())
    counted = {(r.toxic, r.bucket): r.n for r in toxicity.bucket_counts(toxicity.training_rows(table, labels, "doc_id", "text"), settings).collect()}
    for side in (0, 1):
        assert counted[side, -1] == totals[side]
        assert {b: n for (s, b), n in counted.items() if s == side and b >= 0} == dict(seen[side])
    a = settings.smoothing
    ratio = {b: math.log((seen[1][b] + a) / (totals[1] + 2 * a)) - math.log((seen[0][b] + a) / (totals[0] + 2 * a)) for b in seen[0] | seen[1]}
    used = np.flatnonzero(model.weights)
    assert 0 < len(used) <= settings.features and all(model.weights[b] * ratio[b] >= -1e-9 for b in used if abs(ratio[b]) > 1)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    for i, t in rows:
        odds = model.intercept + sum(model.weights[b] for b in toxicity.grams([t or ""], settings)[1].tolist())
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].predicted == label[i] for i, _ in rows)
    assert toxicity.score(empty(table).where(F.lit(True)), model).count() == 0
