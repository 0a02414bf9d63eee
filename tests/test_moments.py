"""Mergeable medians, covariances and components against whole-matrix versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.models.pca import shrunk_covariance, two_components
from tidemark.operators import moments
from tidemark.sources.scratch import Folder


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(7)
    out = {}
    for label, n in ((1, 201), (2, 40), (9, 2), (5, 1)):
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + rng.normal(size=4) * 3
        x[:, 3] = np.round(x[:, 3])  # ties, zeros of both signs
        out[label] = x
    out[1][0, 3], out[1][1, 3] = -0.0, 0.0
    return out


def frame(spark, labelled):
    rows = [(k, i, 1.0 + i % 3, x.tolist()) for k, v in labelled.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "label int, id int, w double, x array<double>").repartition(5)


def test_ordered_bits():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 3.0, np.inf])
    bits = moments.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert moments.doubles(bits).tolist() == x.tolist()


def test_medians_are_exact(spark, labelled):
    got = {r.label: r.centre for r in moments.medians(frame(spark, labelled), Folder(spark, "m")).collect()}
    assert got.keys() == labelled.keys()
    for k, x in labelled.items():
        assert got[k] == np.median(x, axis=0).tolist()


def test_shrunk_covariances(spark, labelled):
    means = {k: np.average(x, axis=0, weights=1.0 + np.arange(len(x)) % 3) for k, x in labelled.items()}
    centre = spark.createDataFrame([(k, m.tolist()) for k, m in means.items()], "label int, centre array<double>")
    out = moments.covariances(frame(spark, labelled).join(centre, "label")).collect()
    for k, x in labelled.items():
        want = shrunk_covariance(x - means[k], 1.0 + np.arange(len(x)) % 3)
        got = np.zeros((4, 4))
        for r in out:
            if r.label == k:
                got[r.i - 1, r.j - 1] = r.cov
        assert got == pytest.approx(want, abs=1e-9)


def test_components(spark, labelled):
    out = moments.components(frame(spark, labelled).where(F.col("label") < 5), Folder(spark, "m")).collect()
    for k in (1, 2):
        want = two_components(labelled[k])
        got = np.array([[r.pc1, r.pc2] for r in sorted((r for r in out if r.label == k), key=lambda r: r.id)])
        assert got == pytest.approx(want, abs=1e-8)
