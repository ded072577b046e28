"""The minimum-covariance-determinant estimate against a plain numpy version with many random starts."""

import numpy as np
import pytest
from ledgerflow.llm import quality
from pyspark.sql import functions as F


def plain_mcd(x, seed, starts=40):
    """Location, consistent scatter with floors and squared distances of the best of many random starts."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(quality.SUPPORT * len(x))), None
    for _ in range(starts):
        own = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            m, c = own.mean(axis=0), np.cov(own.T, bias=True) * quality.CONSISTENCY
            c[np.diag_indices(4)] = np.maximum(np.diag(c), np.square(quality.FLOORS))
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d2)[:h]]
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c, d2
    return best


@pytest.fixture(scope="module")
def samples():
    rng, out = np.random.default_rng(11), {}
    for g, n, bad in (("a", 400, 60), ("b", 900, 200), ("c", 300, 0)):
        mix = rng.normal(size=(4, 4)) + 2 * np.eye(4)
        x = rng.normal(size=(n, 4)) @ mix + rng.normal(size=4) * 5
        x[:bad] = x[:bad] * 0.3 + 60 + rng.normal(size=(bad, 4))  # a tight cluster far off, which drags means and covariances along
        out[g] = x, bad
    return out


def test_estimate_equals_a_plain_version(spark, samples):
    rows = spark.createDataFrame([(g, *map(float, r)) for g, (x, _) in samples.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    model = quality.fit(rows)
    found = {r.g: r for r in model.collect()}
    d2 = {g: np.array([r.d2 for r in quality._distances(rows.where(F.col("g") == g), model).collect()]) for g in samples}
    for g, (x, bad) in samples.items():
        log_det, m, c, wanted = plain_mcd(x, 3)
        lower = np.array([[found[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose([found[g][f"m{i}"] for i in range(4)], m, atol=0.1 * np.sqrt(np.diag(c)).max())
        assert np.allclose(lower @ lower.T, c, rtol=0.2, atol=0.1 * np.diag(c).max())
        assert abs(found[g].log_det - log_det) < 0.15
        assert ((d2[g] > quality.CUTOFF) == (wanted > quality.CUTOFF)).all() and (d2[g] > quality.CUTOFF)[:bad].all() and not (d2[g] > quality.CUTOFF)[bad:].any()


def test_consistency_and_cutoff_are_chi_square_values():
    x = np.random.default_rng(1).chisquare(4, 4_000_000)
    q = np.quantile(x, quality.SUPPORT)
    assert quality.CONSISTENCY == pytest.approx(quality.SUPPORT / np.mean(np.random.default_rng(2).chisquare(6, 4_000_000) <= q), rel=0.005)
    half = quality.CUTOFF / 2
    assert np.exp(-half) * (1 + half) == pytest.approx(1e-6, rel=0.01)


def test_small_groups_fall_back(spark):
    """A pair of few rows is judged by its language, a language of few by all rows; no row that passes is without distance."""
    rng = np.random.default_rng(4)

    def text(symbols=0):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + "#" * (symbols and rng.integers(0, symbols)) for _ in range(60))

    rows = [(i, text(), "en", "big") for i in range(80)] + [(100 + i, text(), "en", "small") for i in range(5)] + [(200 + i, text(), "xx", None) for i in range(3)] + [(300, text(), None, "big")]
    rows += [(400, text(30), "en", "small"), (401, text(30), "xx", None), (402, text(30), None, "big"), (403, None, "en", "small"), (404, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(r.distance is not None for r in found.values() if not r.base_failed)
    assert sorted(i for i, r in found.items() if not r.kept) == [400, 401, 402, 403, 404]
    assert quality.judge(docs.where("doc_id > 402")).where("kept").count() == 0 and quality.judge(docs.where("doc_id < 0")).count() == 0
    one = quality.judge(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].kept
