"""The quality model is learned from all labelled rows and all of their pairs."""

import numpy as np
import pytest

from faultline.llm import quality_classifier as qc


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    x = rng.random((700, 8 + 512)).astype(np.float32)
    y = x[:, 0] + 0.3 * rng.normal(size=700) > 0.5
    return x, y


def test_more_pairs_than_twenty_thousand_all_count(rows):
    x, y = rows[0][:, :6].astype(float), rows[1]
    good, bad = x[y], x[~y]
    assert len(good) * len(bad) > 100_000
    w = qc.bradley_terry(good, bad, ridge=0.01)
    diff = (good[:, None] - bad).reshape(-1, 6)
    assert np.abs(qc.gradient(w, diff, 0.01)).max() < 1e-8


def test_tasks_learn_what_memory_learns(spark, rows):
    x, y = rows
    table = spark.createDataFrame([(bool(b), r.tobytes()) for r, b in zip(x, y)], "good boolean, x binary").repartition(40)
    a, b = qc.learned(x, y), qc.model_of(qc.in_tasks(table), x.shape[1], 0.7)
    assert np.allclose(a.weights, b.weights, atol=1e-7) and abs(a.offset - b.offset) < 1e-7


@pytest.mark.parametrize("ties", [False, True])
def test_the_cut_is_exact(monkeypatch, rows, ties):
    monkeypatch.setattr(qc, "MOST", 5)
    monkeypatch.setattr(qc, "BINS", 16)
    x, y = np.round(rows[0], 1) if ties else rows[0], rows[1]
    w = np.zeros(x.shape[1])
    w[:2] = 3, -1
    s = np.sort(np.concatenate([x[k : k + qc.CHUNK] @ w for k in range(0, len(x), qc.CHUNK)]))
    for k in (1, 200, 350, 699):
        assert abs(qc.cut(qc.in_memory(x, y), w, k) - (s[k - 1] + s[k]) / 2) < 1e-12
