"""The trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from vesselwatch.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [e[2] for e in sorted(v, key=lambda e: e[:2])] for c, v in own.items()}
    members, full = defaultdict(list), {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        family = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        full[conv] = own.get(family, [])[:h] + turns[h:]
        for d in range(len(full[conv]) + 1):
            members[tuple(full[conv][:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        found = [out[x] for x in children[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(x[6] for x in found)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(found), sum(x[5] for x in found) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def _found(nodes) -> list[tuple]:
    return sorted(map(tuple, nodes.collect()), key=lambda r: r[:2])


def _rows() -> list[tuple]:
    rng = random.Random(2)
    rows = [(rng.randrange(-8, 40), rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "é", None, "x", "x"])) for _ in range(160)]
    return [*rows, (None, 1, "u", "x"), *((c, t, "u", f"same{t}") for c in range(100, 125) for t in range(4))]


@pytest.mark.parametrize(("local", "segment"), [(10_000, 512), (0, 2), (60, 3)])
def test_nodes_equal_brute_force_whatever_is_local(spark, local, segment):
    """All in one bucket; every bucket split; buckets that end within segments."""
    rows = _rows()
    assert _found(prefix_trie(spark.createDataFrame(rows, SCHEMA), local, segment)) == _brute(rows)


def test_small_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0
    for rows in ([(7, 0, "u", "x")], [(0, None, None, None)], [(3, t, "u", "x" * t) for t in range(9)]):
        clashing = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, depth int, digest int")
        assert _found(prefix_trie(clashing)) == _brute(rows)


def test_a_long_conversation_and_its_copies(spark):
    rows = [(c, t, "u", f"t{t % 7}") for c in (5, 10, 11) for t in range(400)]
    assert _found(prefix_trie(spark.createDataFrame(rows, SCHEMA), local=1300, segment=50)) == _brute(rows)
