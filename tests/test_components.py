"""Components by star contraction against a search, over chains, stars and a component of a third of all nodes."""

import random

import pytest

from tapewright.functions.components import components
from tapewright.operators.joins import connected_groups


def search(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        stack = [] if start in out else [start]
        while stack:
            n = stack.pop()
            if n not in out:
                out[n] = start
                stack += near[n]
    return out


def shapes():
    rnd = random.Random(7)
    names = list(range(3_000))
    rnd.shuffle(names)
    chain = list(zip(names[:900], names[1:901], strict=True))
    star = [(names[1_000], n) for n in names[1_001:1_700]]
    large = [(max(names) + 1, n) for n in names[1_800:2_100]]  # the center is the largest node
    loose = [(rnd.choice(names[2_200:]), rnd.choice(names[2_200:])) for _ in range(500)]
    return {"chain": chain, "ordered chain": [(i, i + 1) for i in range(700)], "star": star, "large center": large, "loose": loose, "all": chain + star + large + loose + [(5, 5), (None, 3), (9_999, 9_999)]}


@pytest.mark.parametrize("shape", list(shapes()))
def test_components(spark, shape):
    links = shapes()[shape]
    got = components(spark.createDataFrame(links + links[:50], "a long, b long").repartition(4)).collect()
    assert {r.node: r.comp for r in got} == search(links) and len(got) == len(search(links))


def test_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_groups_of_a_hot_identifier(spark):
    rows = [(f"T{i}", "hot" if i % 3 == 0 else f"f{i // 4}") for i in range(600)] + [("X", None), ("Y", "own"), ("T1", "f200")]
    links = [(t, "z" + f) for t, f in rows if f]
    want = search(links)
    got = {r.ticker: r.group_id for r in connected_groups(spark.createDataFrame(rows, "ticker string, figi string"), "ticker", "figi").collect()}
    assert got == {t: want.get(t, t) for t, _ in rows}
