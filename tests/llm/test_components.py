"""Connected components against a plain search."""

import random

import pytest

from roadtrace.llm.components import components


def _plain(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            node = stack.pop()
            if node not in found:
                found[node] = start
                stack += near[node]
    return found


def _links(kind):
    r = random.Random(5)
    if kind == "chain":
        order = list(range(60))
        r.shuffle(order)
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(7, i) for i in range(200)] + [(i, 7) for i in range(20)]
    if kind == "random":
        return [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    return [(None, 1), (2, None), (3, 3)]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "nothing"])
def test_same_as_search(spark, kind):
    links = _links(kind)
    rows = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == _plain(links)
