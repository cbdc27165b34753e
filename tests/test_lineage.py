"""Everything a node rests on, against a breadth-first walk, with cycles, repeated edges and nulls."""

import random

from welltide.operators.lineage import ancestry, channel_coverage, channel_edges

EDGES = "well_id long, node string, parent string"


def walk(edges):
    out = {}
    for well, start in {(w, n) for w, n, _ in edges}:
        frontier, step = {start}, 0
        while frontier:
            step += 1
            frontier = {p for w, n, p in edges if w == well and n in frontier} - {a for w, n, a in out if (w, n) == (well, start)}
            out |= {(well, start, a): step for a in frontier}
    return out


def test_ancestry_equals_a_walk(spark):
    rng = random.Random(3)
    edges = [(w, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for w in range(4) for _ in range(14)]
    edges += [(9, f"n{i}", f"n{i + 1}") for i in range(7)] + [(9, "n7", "n0")]  # a ring of eight
    df = spark.createDataFrame(edges + edges[:5] + [(1, None, "n1"), (1, "n1", None)], EDGES)
    rows = ancestry(df).collect()
    got = {(r.well_id, r.node, r.ancestor): r.steps for r in rows}
    assert got == walk(edges) and len(rows) == len(got)
    one = ancestry(df, spark.createDataFrame([(9, "n3")], "well_id long, node string")).collect()
    assert {(r.ancestor, r.steps) for r in one} == {(f"n{(3 + i) % 8}", i) for i in range(1, 9)}
    assert ancestry(df.limit(0)).count() == 0


def test_only_recorded_channels_are_sources(spark):
    wide = spark.createDataFrame([(1, 0, 5.0, None), (1, 1, 6.0, None), (1, 2, None, None), (2, 0, None, 1.0)], "well_id long, pos long, a double, b double")
    cover = channel_coverage(wide, ["a", "b"])
    assert sorted(map(tuple, cover.collect())) == [(1, "a", 2, 1), (2, "b", 1, 0)]
    assert sorted(map(tuple, channel_edges(cover, [("x", "a"), ("y", "a"), ("z", "b")]).collect())) == [
        (1, "x", "channel:a", "recorded"), (1, "y", "channel:a", "recorded"), (2, "z", "channel:b", "recorded")]
