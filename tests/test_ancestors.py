import random

import pytest
from conceptile.operators import ancestors as M
from conceptile.operators.ancestors import are_ancestors, labels


def above(edges):
    up = {}
    for p, c in edges:
        up.setdefault(c, set()).add(p)

    def all_above(n):
        seen, todo = {n}, [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    return all_above


@pytest.mark.parametrize(("bits", "extra"), [(64, 0), (512, 6)])
def test_pairs_equal_a_search(spark, bits, extra):
    """Trees with cross edges and cycles; with 64 bits many labels say perhaps where the answer is no."""
    rng = random.Random(bits)
    edges = [(f"c{rng.randrange(max(0, i - 30), i)}", f"c{i}") for i in range(1, 150)] + [(f"c{rng.randrange(150)}", f"c{rng.randrange(150)}") for _ in range(extra)]
    edges += [("c3", "c3"), edges[0]]
    pairs = [(f"c{rng.randrange(150)}", f"c{rng.randrange(150)}") for _ in range(300)] + [("c140", "c0"), ("c0", "c140"), ("lone", "lone"), ("lone", "c0"), ("c0", "lone"), (None, "c0"), ("c1", None), ("c1", "c1")]
    search = above(edges)
    got = {(r.node, r.ancestor): r.holds for r in are_ancestors(spark.createDataFrame(pairs, "node string, ancestor string"), spark.createDataFrame([*edges, (None, "c1")], "parent string, child string"), bits).collect()}
    assert got == {(n, a): a in search(n) for n, a in pairs if n and a} and 5 < sum(got.values()) < 300


def test_labels_grow_downwards(spark):
    rows = labels(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4)], "parent long, child long"), 64).collect()
    ones = {r.node: bin(r._l0 & (1 << 64) - 1).count("1") for r in rows}
    assert ones[1] == 1 and ones[4] == 1 and ones[2] == ones[3] == 3


def test_no_edges_and_odd_labels(spark):
    none, pairs = spark.createDataFrame([], "parent long, child long"), spark.createDataFrame([(1, 1), (1, 2)], "node long, ancestor long")
    assert {(r.node, r.ancestor, r.holds) for r in are_ancestors(pairs, none).collect()} == {(1, 1, True), (1, 2, False)}
    with pytest.raises(ValueError):
        are_ancestors(pairs, none, 100)


@pytest.mark.parametrize("most", [1, 2, 5, 40])
def test_whole_sets_and_searches_agree(spark, most):
    """A cycle with nodes above and below it, cross edges, a node with many parents; sets of any bound."""
    rng = random.Random(most)
    edges = [(rng.randrange(max(0, i - 6), i), i) for i in range(1, 60)] + [(rng.randrange(40), rng.randrange(40, 60)) for _ in range(5)] + [(20, 3), (7, 7)] + [(100 + i, 59) for i in range(10)]
    search = above(edges)
    frame = spark.createDataFrame(edges, "parent long, child long").distinct()
    got = {r.node: None if r.up is None else sorted(r.up) for r in M.above(frame, most).collect()}
    assert got == {n: sorted(search(n)) if len(search(n)) <= most else None for n in {x for e in edges for x in e}}
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)] + [(59, 105), (59, 0), (3, 20)]
    asked = {(r.node, r.ancestor): r.holds for r in are_ancestors(spark.createDataFrame(pairs, "node long, ancestor long"), frame, most=most).collect()}
    assert asked == {(n, a): a in search(n) for n, a in pairs}


def test_deep_narrow_trees_are_not_searched(spark, monkeypatch):
    """Paths of 30 steps: a few doublings decide all pairs, where each step was a round of labels and another of the search."""
    rounds = []
    put = M.Table.put
    monkeypatch.setattr(M.Table, "put", lambda self, df: rounds.append(self.name) or put(self, df))
    edges = [(f"{p}-{i}", f"{p}-{i + 1}") for p in "ab" for i in range(30)]
    pairs = [("a-30", "a-0"), ("a-30", "b-0"), ("b-15", "b-16"), ("b-16", "b-15")]
    got = are_ancestors(spark.createDataFrame(pairs, "node string, ancestor string"), spark.createDataFrame(edges, "parent string, child string")).collect()
    assert {(r.node, r.ancestor): r.holds for r in got} == dict(zip(pairs, (True, False, False, True), strict=True))
    assert len(rounds) <= 10 and "seen" not in rounds
