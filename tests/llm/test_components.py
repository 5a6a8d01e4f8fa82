"""Connected components: which tables they write, and what near dedup asks of the driver."""

import random

import pytest

from gaugework.llm import common, components, ngram_join
from gaugework.llm.components import connected_components
from gaugework.llm.ngram_join import ngram_components


@pytest.fixture
def written(monkeypatch):
    """The names of the tables that are written, in order."""
    names, write = [], common.materialize

    def materialize(df, name, path=None):
        names.append(name)
        return write(df, name, path)

    for module in (common, components):
        monkeypatch.setattr(module, "materialize", materialize)
    return names


def least(edges):
    """node -> least node that edges reach."""
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def found(spark, edges):
    return {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_stars_to_least_nodes_take_no_step(spark, written):
    edges = [(1, 5), (5, 1), (7, 1), (1, 9), (2, 4), (3, 3)]
    assert found(spark, edges) == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 4: 2}
    assert len(written) == 1


def test_a_star_to_a_larger_node_takes_one_step(spark, written):
    edges = [(5, 1), (5, 7), (5, 9)]
    assert found(spark, edges) == {1: 1, 5: 1, 7: 1, 9: 1}
    assert len(written) == 2


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(1, 2), (2, 3)], [(i, i + 1) for i in range(40)], [(1, 9), (2, 9)], [(3, 2), (3, 1)], [(1, 2), (3, 4), (2, 4)]])
def test_components_of_small_graphs(spark, edges):
    assert found(spark, edges) == least(edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)]
    assert found(spark, edges) == least(edges)


def test_near_dedup_takes_its_last_components_from_its_merges(spark, written):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(i, " ".join([*base[: i + 10], f"e{i}", *base[i + 11 :]])) for i in range(30)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)] + [(200, "a b c d e f g h"), (201, "a b c d e f g h"), (300, "none of these words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(docs, 5, 80).collect()}
    assert got == {i: 0 for i in [*range(30), *range(100, 120)]} | {200: 200, 201: 200, 300: 300}
    assert written.count("ngram-components") == 1


def test_rows_of_one_doc_id_with_different_texts_are_one_node(spark):
    one, two = ("one " * 3 + "red green blue black white grey"), ("two " * 3 + "oak elm ash fir yew pine")
    rows = [(3, one), (4, two), (5, one), (5, two), (9, "nothing like the others at all")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 9)]
    assert ngram_join.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).count() == 2
