"""Components by star contractions: right on chains, and no round is made of stars."""

import random

from driftline.llm import components


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).distinct().collect()
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in linked)


def test_stars_are_written_once(spark, monkeypatch):
    written, kept = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or kept(df, name))
    links = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(50, 40)], "a long, b long")
    found = components.connected_components(links).distinct().collect()
    assert len(written) == 1
    assert {tuple(r) for r in found} == {(i, 1) for i in range(1, 30)} | {(40, 40), (50, 40)}
