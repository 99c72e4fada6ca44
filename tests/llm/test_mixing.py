from collections import Counter
from math import ceil, floor

import pytest
from conceptile.llm.mixing import blocks_in_turn, mixed, mixing_stage, one_period, op6_pfair_mixture, phases, quanta
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=12))
def test_every_prefix_is_within_one_block_of_the_weights(parts):
    named = {f"s{i}": q for i, q in enumerate(parts)}
    order, total, done = one_period(named), sum(parts), Counter()
    assert Counter(order) == named
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert floor((done[s] - 1) * total / named[s]) < t <= ceil(done[s] * total / named[s])
        assert all(abs(done[x] * total - t * q) < total for x, q in named.items())


def test_quanta_are_whole_and_proportional():
    got = quanta({"a": 0.5, "b": 0.25, "c": 0.25, "d": 1e-9}, 1024)
    assert sum(got.values()) == 1024 and got["d"] == 1 and abs(got["a"] - 512) < 4


def simulated(rows, weights, block, period):
    """Slots block by block, with weights scaled up whenever a source ends."""
    left, done, slots, t = {s: ceil(n / block) for s, n in rows.items() if n}, Counter(), {}, 0
    while left:
        parts = quanta({s: weights[s] for s in left}, max(period, 4 * len(left)))
        order, i = one_period(parts), 0
        while True:
            s = order[i % len(order)]
            slots[s, done[s]] = t
            done[s] += 1
            left[s] -= 1
            t, i = t + 1, i + 1
            if not left[s]:
                del left[s]
                break
    return slots


def test_phases_equal_a_simulation():
    rows, weights = {"a": 1000, "b": 37, "c": 400, "d": 1}, {"a": 1.0, "b": 2.0, "c": 3.0, "d": 0.1}
    got = {}
    for s, _, first, n, parts, period, start, places, _ in phases(rows, weights, 3, 16):
        for k in range(n):
            got[s, first + k] = start + k // parts * period + places[k % parts]
    assert got == simulated(rows, weights, 3, 16)


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, None: 1.0}])
def test_whole_table_is_placed_once(spark, sf_dir, weights):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixed(docs, weights, block=4).collect()
    assert sorted(r.position for r in got) == list(range(docs.count())) and len({r.doc_id for r in got}) == len(got)
    by_position = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in by_position] == sorted(r.slot for r in got)
    assert all(len({r.source for r in got if r.slot == s}) == 1 for s in {r.slot for r in got})
    sizes = Counter(r.source for r in got)
    target = {f"{s}": (sizes[s] ** 0.5 if weights is None else weights.get(s, 0)) for s in sizes}
    first = {r.slot: r.source for r in got if r.phase == 0}
    if weights is None:
        assert {(r.source, r.block): r.slot for r in got} == simulated(sizes, target, 4, 1024)
    else:
        assert Counter(first.values())["src0"] >= 2 * Counter(first.values())["src1"] and set(first.values()) <= {"src0", "src1"}


def test_defined_cases(spark, docs):
    rows = [(1, "a", None, None), (2, None, None, ""), (2, None, None, ""), (None, "x", None, "s"), (5, "y" * 100_000, None, "s"), *[(9, "same", None, "hot")] * 300]
    df = docs(rows, ["position", "slot", "rank", "key", "n", "first", "doc"])
    got = mixed(df, block=2).collect()
    assert sorted(r.position for r in got) == list(range(len(rows))) and Counter(r.source for r in got) == Counter(r[3] for r in rows)
    staged = mixing_stage(spark, df, "")
    assert staged.columns == df.columns and sorted(staged.collect(), key=str) == sorted(df.collect(), key=str)
    assert mixed(docs([])).collect() == []


def test_query_keeps_all(spark, sf_dir):
    assert op6_pfair_mixture(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("weights", [{"a": 0.9999, "b": 0.0001}, {"hot": 1825.7, **{f"s{i}": 592.3 for i in range(19)}}, {f"s{i:03}": 1.0 + 20 * (i == 0) for i in range(300)}])
def test_every_prefix_of_a_long_schedule_is_within_one_block_of_the_true_weights(weights):
    """Parts of a period of 1024 drift from such weights by more blocks the longer the schedule is."""
    from fractions import Fraction

    rows = {s: 40_000 if w == max(weights.values()) else 20_000 for s, w in weights.items()}
    names, got = blocks_in_turn(rows, weights, 1)
    total, done = sum(map(Fraction, weights.values())), Counter()
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t, (i, phase) in enumerate(zip(got["source"], got["phase"]), 1):
        if phase:
            break
        s = names[i]
        done[s] += 1
        assert abs(done[s] - t * share[s]) < 1
        if t % 5000 == 0:
            assert all(abs(done[x] - t * share[x]) < 1 for x in share)
    assert t > 30_000 and len(got["source"]) == sum(rows.values())


def test_no_source_is_behind_in_a_schedule_of_two():
    names, got = blocks_in_turn({"a": 20_000, "b": 20_000}, {"a": 0.9999, "b": 0.0001}, 1)
    of_b = [t for t, (i, p) in enumerate(zip(got["source"], got["phase"])) if names[i] == "b" and not p]
    assert len(of_b) in (2, 3)  # two ten-thousandths of 20,000 blocks, not one in 1024


def plain(rows, weights):
    """Earliest deadline first over a list of all blocks, slot by slot, in exact fractions; whoever ends, a new phase begins."""
    from fractions import Fraction
    from math import ceil, floor

    left, done, order = {s: n for s, n in rows.items() if n}, Counter(), []
    while left:
        group = [s for s in left if weights.get(s, 0) > 0] or list(left)
        of = {s: Fraction(weights[s]) if weights.get(s, 0) > 0 else Fraction(rows[s] ** 0.5) for s in group}
        total, taken, t = sum(of.values()), Counter(), 0
        while True:
            share = {s: of[s] / total for s in group}
            ready = [(ceil((taken[s] + 1) / share[s]), -of[s], s) for s in group if floor(taken[s] / share[s]) <= t]
            s = min(ready)[2]
            order.append((s, done[s]))
            done[s] += 1
            taken[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
                break
    return order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([0.0, 0.1, 0.3, 1.0, 2.5, 1e-4, 100.0])), min_size=1, max_size=9))
def test_schedules_equal_a_plain_one(sources):
    rows, weights = {f"s{i}": n for i, (n, _) in enumerate(sources)}, {f"s{i}": w for i, (_, w) in enumerate(sources)}
    names, got = blocks_in_turn(rows, weights, 1)
    assert [(names[i], int(b)) for i, b in zip(got["source"], got["block"])] == plain(rows, weights)


def test_many_sources_take_time_by_blocks():
    import time

    start = time.time()
    names, got = blocks_in_turn({f"s{i:05}": 1 + i % 7 for i in range(20_000)}, {f"s{i:05}": 1.0 + i % 13 for i in range(20_000)}, 1)
    assert len(got["source"]) == sum(1 + i % 7 for i in range(20_000)) and time.time() - start < 60


def test_blocks_grow_with_a_large_corpus(spark, docs, monkeypatch):
    import conceptile.llm.mixing as mixing

    monkeypatch.setattr(mixing, "MOST_BLOCKS", 5)
    got = mixed(docs([(i, "x", None, f"s{i % 3}") for i in range(100)]), block=2).collect()
    assert sorted(r.position for r in got) == list(range(100)) and max(r.slot for r in got) < 5 + 3
