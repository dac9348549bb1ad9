"""What the trained operators learn from, against plain recounts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from shelfsight.llm.bytewords import text_buffer
from shelfsight.llm.labelled import training_sample
from shelfsight.llm.quality_knn import QualitySettings, sample_matrix, text_vectors, votes, weighted
from shelfsight.llm.toxicity import IDENTITY_TERMS, ToxicitySettings, toxicity

TEXTS = ["a plain line of words", "", "MANY ### $$ marks $$ here", "a a a b", "x" * 3000, "déjà vu, 12 times!"]


def test_sample_has_one_text_for_an_id(spark):
    docs = spark.createDataFrame(
        [(i, t, "extra") for i in range(1, 40) for t in ("one", "two", "two", None)], "doc_id long, text string, label string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = training_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10
    assert all(r.label == r.doc_id % 2 for r in got) and len({r.text for r in got}) == 1


def test_sample_vectors_equal_those_of_the_texts(spark):
    settings = QualitySettings(buckets=64)
    idf = np.linspace(0.5, 2.0, 64)
    sample = spark.createDataFrame([(9 - i, t, i % 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, label int")
    matrix, label = sample_matrix(sample.repartition(3), idf, settings)
    direct = [weighted(*text_vectors(*text_buffer(pa.array([t])), 64), idf, settings.shape_weight) for t in reversed(TEXTS)]
    assert np.array_equal(matrix, np.concatenate(direct))
    assert label.tolist() == [i % 2 for i in reversed(range(len(TEXTS)))]
    none, empty = sample_matrix(sample.limit(0), idf, settings)
    assert none.shape == (0, matrix.shape[1]) and not len(empty)


def test_votes_equal_all_cosines_one_by_one():
    rng = np.random.default_rng(3)
    known, label = rng.standard_normal((40, 5)), rng.integers(0, 2, 40).astype(float)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    asked = np.concatenate([rng.standard_normal((30, 5)), np.zeros((1, 5))])
    got = votes(asked, known, label, 7, 8.0)
    for vector, score in zip(asked, got, strict=True):
        length = math.sqrt(sum(x * x for x in vector))
        cosines = [max(0.0, sum(x * y for x, y in zip(vector, k, strict=True)) / length) if length else 0.0 for k in known]
        best = sorted(range(40), key=lambda i: -cosines[i])[:7]
        total = sum(cosines[i] ** 8 for i in best)
        expected = sum(cosines[i] ** 8 * label[i] for i in best) / total if total > 1e-9 else label.mean()
        assert score == pytest.approx(expected, abs=1e-9)


def test_penalty_shrinks_the_change_of_every_swap(spark):
    toxic = [f"the {a} next door are vile rotten scum number {i}. A day." for i in range(12) for a in ("women", "gay", "muslims")]
    clean = [f"the {a} next door made a kind dinner number {i}. A day." for i in range(12) for a in ("men", "straight", "christians")]
    rows = [(i, t, i % 2) for i, t in enumerate(x for pair in zip(clean, toxic, strict=True) for x in pair)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    asked = [(1000 + k, f"the {term} next door are here") for k, term in enumerate(t for g in IDENTITY_TERMS[:5] for t in g)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + asked, "doc_id long, text string")

    def spread(weight):
        settings = ToxicitySettings(counterfactual=weight, least_statistic=3.0)
        score = {r.doc_id: r.score for r in toxicity(docs, labels, settings).collect()}
        of = {term: score[1000 + k] for k, term in enumerate(t for g in IDENTITY_TERMS[:5] for t in g)}
        assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)
        return [max(of[t] for t in g) - min(of[t] for t in g) for g in IDENTITY_TERMS[:5]]

    free, held = spread(0.0), spread(50.0)
    assert max(free) > 0.05
    assert all(h <= f / 2 + 1e-6 for f, h in zip(free, held, strict=True))


def test_licence_probabilities_are_calibrated_and_the_scan_composes(spark):
    from shelfsight.llm.licences import OTHERS_HELD_OUT, TEMPLATES, licence_scan, train

    rows = [(i, t) for i, t in enumerate(OTHERS_HELD_OUT)] + [(100 + i, t) for i, (_, t) in enumerate(TEMPLATES)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = train(docs)
    assert model.held_out >= 6 * len(TEMPLATES) + len(OTHERS_HELD_OUT) and 0.1 < model.scale < 10
    assert model.error_after < 0.1
    found = licence_scan(docs).where("n_notices > 0 AND n_scored > 0").select("doc_id", "families").where("families != ''")
    assert {r.doc_id: r.families for r in found.collect()} == {100 + i: f for i, (f, _) in enumerate(TEMPLATES)}


def test_calibration_recovers_overconfident_odds(spark):
    from shelfsight.llm.licences import _calibrated

    rows = []
    for odds in range(-6, 7):
        hits = round(200 / (1 + math.exp(-0.5 * odds)))
        rows += [(float(odds), int(k < hits)) for k in range(200)]
    scale, shift, n, before, after = _calibrated(spark.createDataFrame(rows, "odds double, hit int"))
    assert n == len(rows) and abs(scale - 0.5) < 0.02 and abs(shift) < 0.02 and after < before
    assert _calibrated(spark.createDataFrame([(1.0, 1)] * 3, "odds double, hit int"))[:3] == (1.0, 0.0, 3)
