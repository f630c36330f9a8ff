import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing

TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def solved(p, n, share, whole, least):
    """Plain projected gradient over all rates, in many small steps."""
    r, a = np.maximum(np.ones(len(n)), least), (p * n[:, None]).T
    pace = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
    for _ in range(4000):
        r = np.maximum(r - pace * (p @ (a @ r - share * whole)), least)
    return a @ r


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_totals_meet_targets_as_brute_force_does(docs, least):
    known = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    mix = mixing.fit(docs, known, TARGETS, least)
    rows = mixing.apply(docs, mix).collect()
    p, n, r = (np.array([x[k] for x in rows]) for k in ("posteriors", "n_tokens", "rate"))
    share = np.array([TARGETS[d] for d in mix.domains])
    got = (p * (n * r)[:, None]).sum(0)
    whole = max(n.sum(), *(least * (p * n[:, None]).sum(0) / share))
    assert np.allclose(got, share * whole, rtol=2e-3)
    assert np.allclose(got, solved(p, n, share, whole, least), rtol=5e-3)
    assert (r >= least).all() and np.allclose(p.sum(1), 1)
    out = [x for x in rows if x.doc_id % 2 and x.n_tokens > 20]
    assert sum(x.domain == x.lang for x in out) >= 0.95 * len(out)
    if least:
        copies = mixing.repeated(docs, mix, at_once=2)
        assert copies.columns == docs.columns
        count = {x.doc_id: x["count"] for x in copies.groupBy("doc_id").count().collect()}
        assert all(int(x.rate) <= count[x.doc_id] <= int(x.rate) + 1 for x in rows)


def test_edge_cases(spark, docs):
    rows = spark.createDataFrame([(1, None, "a", 2.0), (1, None, "a", 2.0), (None, "", "b", 1.0), (3, "hello " * 200_000, "c", 0.0)], "doc_id long, text string, domain string, rate double")
    for known in (rows.select("doc_id", "domain").limit(0), rows.select("doc_id", "domain"), spark.createDataFrame([(3, "en"), (3, "de"), (None, "fr")], "doc_id long, domain string")):
        got = mixing.apply(rows, mixing.fit(rows, known, TARGETS)).collect()
        assert sorted(x.n_tokens for x in got) == [0, 0, 0, 200_000] and all(x.rate >= 0 for x in got)
    empty = docs.limit(0)
    assert mixing.apply(empty, mixing.fit(empty, empty.select("doc_id", F.col("lang").alias("domain")), TARGETS)).collect() == []


def test_infeasible_targets_are_reported(docs):
    """A domain that no document has can't be filled; the rest is fitted and the Mix tells the gap."""
    known = docs.where("lang != 'es'").select("doc_id", F.col("lang").alias("domain"))
    with pytest.warns(UserWarning, match="can't be met"):
        mix = mixing.fit(docs.where("lang = 'en'"), known, {"en": 0.0, "de": 1.0}, total=1e9)
    assert np.abs(mix.off).sum() > 1e-3


def test_classifier_gradient_is_zero_where_training_ends():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), rng.integers(3, size=60)
    w = mixing.logistic(x, y, 3, rounds=500, ridge=0.1)

    def loss(w):
        z = np.hstack([x, np.ones((60, 1))]) @ w
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(60), y]).mean() + 0.05 * (w * w).sum())

    for i in range(w.shape[0]):
        for j in range(3):
            up, down = w.copy(), w.copy()
            up[i, j] += 1e-4
            down[i, j] -= 1e-4
            assert abs(loss(up) - loss(down)) / 2e-4 < 2e-3


def test_a_high_rate_is_split(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (2, None, "k")], "doc_id long, text string, times string")
    mix = mixing.Mix(["a"], np.ones(1), np.zeros((2 * mixing.WIDE + 1, 1)), [np.array([-999.0])], 0.0, np.zeros(1))
    got = {r.doc_id: r["count"] for r in mixing.repeated(df, mix, at_once=64).groupBy("doc_id").count().collect()}
    assert got == {1: 1000, 2: 1000}
