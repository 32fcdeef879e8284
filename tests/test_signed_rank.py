"""Signed-rank tests in columns against the plain counts of a list."""

import itertools

import numpy as np
import pytest

from tessera.operators import ablation


def by_signs(differences):
    """Two-sided p-value from every choice of signs."""
    x = [d for d in differences if d]
    ranks = [sorted(map(abs, x)).index(abs(d)) + 1 for d in x]
    w = min(sum(r for r, d in zip(ranks, x, strict=True) if d > 0), sum(r for r, d in zip(ranks, x, strict=True) if d < 0))
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    return min(1.0, 2 * sum(s <= w for s in sums) / len(sums))


def test_signed_rank_equals_every_choice_of_signs(spark):
    rng = np.random.default_rng(1)
    sets = {f"s{n}": rng.normal(0.4, 1, n).tolist() for n in (1, 2, 3, 7, 12)}
    rows = [(k, d) for k, v in sets.items() for d in v]
    out = {r.k: r for r in ablation.signed_rank(spark.createDataFrame(rows, "k string, d double"), "d", ["k"]).collect()}
    for k, v in sets.items():
        assert out[k].n == len(v) and out[k].p_value == pytest.approx(by_signs(v), abs=1e-12)


def test_signed_rank_of_ties_zeros_nulls_and_many(spark):
    rng = np.random.default_rng(2)
    sets = {
        "fifty": rng.normal(0.2, 1, 50).tolist(), "more": rng.normal(0.2, 1, 51).tolist(), "tied": rng.integers(-3, 5, 40).astype(float).tolist(), "even": [1.0, -1.0] * 4,
        "zeros": [0.0, 0.0], "nulls": [None], "some": [None, 0.0, 2.0, -1.0, 3.0], None: [1.0, 2.0],
    }
    rows = [(k, d) for k, v in sets.items() for d in v]
    out = {r.k: r for r in ablation.signed_rank(spark.createDataFrame(rows, "k string, d double"), "d", ["k"]).collect()}
    assert set(out) == set(sets)
    for k, v in sets.items():
        assert out[k].p_value == pytest.approx(ablation.wilcoxon_p([d for d in v if d is not None]), abs=1e-10), k
    assert (out["zeros"].n, out["zeros"].w_plus, out["zeros"].p_value) == (0, 0.0, 1.0) and out["some"].n == 3
    empty = spark.createDataFrame([], "k string, d double")
    assert ablation.signed_rank(empty, "d", ["k"]).count() == 0


def test_signed_rank_needs_no_python_worker(spark):
    d = spark.createDataFrame([("a", 1.0)], "k string, d double")
    assert "Python" not in ablation.signed_rank(d, "d", ["k"])._jdf.queryExecution().executedPlan().toString()
