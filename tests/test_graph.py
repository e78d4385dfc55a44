import math

import numpy as np
import pytest

from weft.operators import graph as g


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, w double")


def test_clean_drops_loops_and_bad_weights_and_sums_repeats(spark):
    got = g.clean(edges(spark, [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.25), (3, 4, 0.0), (3, 4, float("nan")), (5, 6, float("inf")), (7, 8, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.75)]


def test_heat_is_the_matrix_exponential(spark):
    n = 6
    links = [(i, i + 1, 1.0) for i in range(n - 1)]
    w = np.zeros((n, n))
    for a, b, x in links:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    lap = np.eye(n) - w / np.sqrt(np.outer(d, d))
    values, vectors = np.linalg.eigh(lap)
    want = vectors @ np.diag(np.exp(-1.5 * values)) @ vectors.T[:, 0]
    sources = spark.createDataFrame([(0, 2.0)], "node long, mass double")
    got = {r["node"]: r["phi"] for r in g.heat(edges(spark, links), sources, 1.5).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-7)


def test_bessel_coefficients_sum_to_one():
    assert math.isclose(sum(g.bessel_coefficients(2.0, 40, 0)), 1.0, abs_tol=1e-12)


def test_components_of_chains_and_empty(spark):
    chain = [(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)]
    got = {r["node"]: r["root"] for r in g.components(edges(spark, chain)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert g.components(edges(spark, [])).count() == 0


def test_fragmentation_counts_isolated_nodes(spark):
    r = g.fragmentation(edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 0.1)]), 0.5, 5).first()
    assert (r["components"], r["cycle_rank"]) == (3, 1) and r["largest_share"] == pytest.approx(0.6)


def test_fragmentation_curve(spark):
    rows = [(0, 1, 1.0), (1, 2, 0.6), (0, 2, 0.5), (3, 4, 0.1), (2, 3, 0.05)]
    got = [tuple(x) for x in g.fragmentation_curve(edges(spark, rows), [0.9, 0.5, 0.1, 0.01, 2.0], 6).collect()]
    assert [x[:2] + (round(x[2] * 6), x[3]) for x in got] == [(0.9, 5, 2, 0), (0.5, 4, 3, 1), (0.1, 3, 3, 1), (0.01, 2, 5, 1), (2.0, 6, 1, 0)]
