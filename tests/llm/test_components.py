import random

import pytest

from lexicrate.llm.components import least_labels


def labels(spark, ids, links):
    """Labels of nodes 0, 1, ... whose values are ``ids``."""
    nodes = spark.createDataFrame(list(enumerate(ids)), "node long, value long")
    out = least_labels(nodes, spark.createDataFrame(links, "a long, b long"))
    return {r.node: r.value for r in out.collect()}


def test_shuffled_chain_is_one_component(spark):
    n = 500
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    # two more nodes with a link of their own, and one without links
    ids += [900, 800, 700]
    got = labels(spark, ids, [(i, i + 1) for i in range(n - 1)] + [(n, n + 1)])
    assert got == {i: 0 for i in range(n)} | {n: 800, n + 1: 800, n + 2: 700}


@pytest.mark.parametrize("halves", [1, 2])
def test_ascending_halves_are_one_component(spark, halves):
    ids = [halves * i + h for h in range(halves) for i in range(200 // halves)]
    got = labels(spark, ids, [(i, i + 1) for i in range(len(ids) - 1)])
    assert set(got.values()) == {0}


def test_equal_values_are_told_apart_by_root(spark):
    nodes = spark.createDataFrame([(0, 9), (1, 9), (2, 9), (3, 5)], "node long, value long")
    out = least_labels(nodes, spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")).collect()
    assert {r.node: (r.value, r.root) for r in out} == {0: (9, 0), 1: (9, 0), 2: (5, 3), 3: (5, 3)}
