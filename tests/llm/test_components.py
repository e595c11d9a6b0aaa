"""Connected components against union-find."""

import random

import pytest

from cloakframe.llm.common import components


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def some(seed):
    r = random.Random(seed)
    return [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(r.randrange(20, 90))]


CASES = {
    "empty": [],
    "loops": [(1, 1), (2, 2)],
    "star": [(0, k) for k in range(1, 30)],
    "star of the largest": [(99, k) for k in range(30)],
    "path": [(k, k + 1) for k in range(40)],
    "shuffled path": [((k * 17) % 41, ((k + 1) * 17) % 41) for k in range(40)],
    "two centres": [(1, 9), (2, 9)],
    "centre that hangs": [(1, 5), (5, 9)],
    "repeated": [(1, 2), (2, 1), (1, 2)],
    "random 1": some(1),
    "random 2": some(2),
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    found = components(spark.createDataFrame(CASES[name], "a bigint, b bigint")).collect()
    assert sorted((r.node, r.component) for r in found) == sorted(plain(CASES[name]).items())
