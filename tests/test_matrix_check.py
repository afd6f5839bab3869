"""The check of a distance matrix moves runs of pairs, not pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import graph


def _points(spark, x):
    return spark.createDataFrame([(int(3 * i), v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")


@pytest.mark.parametrize("block", [9, 100])
def test_runs_stand_for_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "block_of", lambda n: block)
    monkeypatch.setattr(graph, "_TILE", (4, 8))
    moved = []
    plain = graph.whole_runs
    monkeypatch.setattr(graph, "whole_runs", lambda runs: moved.append(runs.count()) or plain(runs))
    x = np.random.default_rng(2).normal(size=(61, 3))
    assert graph.check_points(_points(spark, x)) == graph.check_pairs(graph.euclidean_pairs(_points(spark, x))) == 61
    assert moved[0] <= 61 * -(-61 // block)  # one run a point and block at most; there are 1,830 pairs


@pytest.mark.parametrize("fault", ["left out", "twice"])
def test_a_matrix_that_is_not_whole_is_told(spark, monkeypatch, fault):
    plain = graph._pair_tiles

    def odd(*a):
        for b in plain(*a):
            yield b.slice(1) if fault == "left out" else b
            if fault == "twice":
                yield b.slice(0, 1)

    monkeypatch.setattr(graph, "_pair_tiles", odd)
    with pytest.raises(ValueError):
        graph.check_points(_points(spark, np.eye(12)))


def test_ids_that_are_there_twice_are_told(spark):
    with pytest.raises(ValueError):
        graph.check_points(_points(spark, np.eye(4)).withColumn("sample_id", F.lit(1).cast("long")))
