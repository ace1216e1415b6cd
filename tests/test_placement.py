"""Placement of shards by hash ring and by load."""

from collections import Counter

from tidemark.operators.advisor import HashRing, least_loaded


def test_ring_moves_only_what_it_must():
    shards = [f"shard-{i}" for i in range(3000)]
    before = {s: HashRing(("a", "b", "c")).node_of(s) for s in shards}
    assert all(700 < n < 1300 for n in Counter(before.values()).values())
    more = HashRing(("d", "c", "b", "a"))
    moves = more.moves(before)
    assert {new for _, _, new in moves} == {"d"} and 400 < len(moves) < 1100
    assert {s for s, _, _ in moves} == {s for s in shards if more.node_of(s) == "d"}
    assert HashRing(()).node_of("x") is None and HashRing(()).moves({"x": "a"}) == []


def test_least_loaded():
    assert least_loaded({"c": 10, "b": 5, "a": 5.0}) == "a"
