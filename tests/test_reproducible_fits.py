"""Fits that depend on the rows only: partitions, copies, hot values; one boundary problem with a gap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.detectors import iforest as T, ocsvm as O

NAMES = ["x", "y", "z"]


def rows(n=3000, hot=True):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES)
    if hot:
        frame.iloc[: n // 3] = [0.25, -0.5, 1.0]  # a third of all rows are equal
    return frame.assign(k=range(n))


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_the_same_forest_for_any_partitioning(spark, keys):
    df = spark.createDataFrame(rows())
    made = []
    for parts in (3, 7, 16):
        shuffled = df.repartition(parts, F.rand(parts))
        made.append(T.grow_forests(shuffled, NAMES, [{"n_estimators": 40}, {"n_estimators": 20, "max_samples": 64}], keys))
    for forests in made[1:]:
        for a, b in zip(made[0], forests):
            pd.testing.assert_frame_equal(a.nodes, b.nodes)
    for forest, size in zip(made[0], (256, 64)):
        leaves = forest.nodes[forest.nodes["feature"] < 0]
        assert (leaves.groupby("tree")["size"].sum() == size).all()
        # the equal rows end together in one leaf, with few others
        assert 0.30 < leaves.groupby("tree")["size"].max().mean() / size < 0.45


@pytest.mark.parametrize("n", [1, 5, 256, 257, 300, 2000])
def test_sample_sizes_on_both_sides_of_small_tables(spark, n):
    """One sampler whatever the size of the table: all rows below the sample size, exactly that many above."""
    df = spark.createDataFrame(rows(n, hot=False))
    forest = T.grow_forests(df, NAMES, [{"n_estimators": 30}])[0]
    leaves = forest.nodes[forest.nodes["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == min(n, 256)).all()


def test_copies_are_drawn_one_by_one(spark):
    df = spark.createDataFrame(rows(6000))
    offered = T.offered_rows(df, NAMES, [(0, t) for t in range(100)], 0.05, 3).toPandas()
    per_tree = offered.groupby("tree").size()
    assert per_tree.mean() == pytest.approx(300, rel=0.05)
    share = offered.assign(hot=offered["x"] == 0.25).groupby("tree")["hot"].mean()
    assert share.mean() == pytest.approx(1 / 3, abs=0.02) and share.std() < 0.06
    kept = offered.sort_values("draw").groupby("tree").head(64)
    assert (kept["x"] == 0.25).mean() == pytest.approx(1 / 3, abs=0.03)
    assert offered["draw"].between(0, 1).all() and offered["draw"].nunique() > 0.999 * len(offered)


def test_the_same_boundary_for_any_partitioning(spark):
    df = spark.createDataFrame(rows())
    grid = [{"nu": 0.02}, {"nu": 0.2, "gamma": 0.5}, {"nu": 0.05, "features": ["x", "z"]}, {"nu": 1.0}]
    made = [O.fit_boundaries(df.repartition(parts, F.rand(parts)), NAMES, grid) for parts in (3, 7, 16)]
    for bounds in made[1:]:
        for a, b in zip(made[0], bounds):
            assert np.allclose(a.normal, b.normal, atol=1e-9) and a.gap == pytest.approx(b.gap, abs=1e-6)
    points = df.toPandas()[NAMES].to_numpy()
    for bound in made[0]:
        assert bound.gap <= O.TOLERANCE and bound.scans > 0
        mapped = bound.mapped(points)
        best = O.least_norm_point(mapped, bound.params["nu"], 4000)
        assert bound.normal @ bound.normal <= (best @ best) * (1 + 2 * O.TOLERANCE) + 1e-12
        # the gap that is reported bounds the true one
        k = bound.params["nu"] * len(points)
        margins = np.sort(mapped @ bound.normal)
        lowest = (margins[: int(k)].sum() + (k - int(k)) * margins[min(int(k), len(margins) - 1)]) / k
        norm = bound.normal @ bound.normal
        assert (norm - lowest) / norm <= bound.gap + 1e-6


def test_a_search_without_a_sample(spark, monkeypatch):
    """The sample only steers: without one, and with a wrong one, the same problem is solved."""
    df = spark.createDataFrame(rows(2000, hot=False))
    want = O.fit_boundaries(df, NAMES, [{"nu": 0.1}])[0]
    monkeypatch.setattr(O, "SAMPLE", 0)
    none = O.fit_boundaries(df, NAMES, [{"nu": 0.1}])[0]
    monkeypatch.setattr(O, "SAMPLE", 12)
    few = O.fit_boundaries(df, NAMES, [{"nu": 0.1}])[0]
    for bound in (none, few):
        assert bound.gap <= O.TOLERANCE and np.linalg.norm(bound.normal - want.normal) < 0.1 * np.linalg.norm(want.normal)


def test_a_search_that_is_stopped_says_so(spark, monkeypatch):
    df = spark.createDataFrame(rows(500, hot=False))
    monkeypatch.setattr(O, "MOST_SCANS", 1)
    with pytest.warns(UserWarning, match="relative gap"):
        bound = O.fit_boundaries(df, NAMES, [{}])[0]
    assert O.Boundary.from_info(bound.info()).gap == bound.gap == np.inf
