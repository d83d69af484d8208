"""Components against union and find, and what rounds they take."""

import random

import pytest

from corpusloom.llm import store
from corpusloom.llm.components import components


def roots(links):
    root = {n: n for link in links for n in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def table(spark, links):
    return spark.createDataFrame(links, "a long, b long").repartition(3)


def shapes():
    r = random.Random(4)
    order = r.sample(range(-500, 500), 300)
    return {
        "chain": list(zip(order, order[1:], strict=False)),
        "hub": [(500, i) for i in range(300)] + [(-1, 1000 + i) for i in range(300)],
        "two parents": [(3, 1), (3, 2), (5, 2), (5, 4)],
        "random": [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(180)],
        "repeats": [(1, 2), (2, 1), (1, 2), (7, 7)],
        "none": [],
        "ends": [(-(1 << 63), (1 << 63) - 1), (0, (1 << 63) - 1)],
    }


@pytest.mark.parametrize("shape", shapes())
def test_smallest_node_reachable(spark, shape):
    links = shapes()[shape]
    got = components(table(spark, links)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == roots(links)


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(table(spark, shapes()["chain"]), 1)


def test_no_round_on_stars(spark, monkeypatch):
    """The driver's memory grows with the tasks it has run; links that are stars already need one minimum by node."""
    labels, staged = [], store.staged
    monkeypatch.setattr(store, "staged", lambda df, label: labels.append(label) or staged(df, label))
    links = [(i, i % 5) for i in range(5, 100)]
    assert {r["node"]: r["root"] for r in components(table(spark, links)).collect()} == roots(links)
    assert labels == ["links", "lows"]
    labels.clear()
    links = [(1, 2), (2, 3)]  # one round makes a star of these
    assert {r["node"]: r["root"] for r in components(table(spark, links)).collect()} == roots(links)
    assert labels == ["links", "lows", "large-star", "least", "small-star", "lows"]
