import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultline.llm import trie
from faultline.llm.shared import Workspace

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        inside = [x for x in members if x[: len(node)] == node]
        kids = [x for x in inside if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in inside)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in inside if x)
        ends = ",".join(str(c) for c in sorted(convs) if full[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    with Workspace(spark, "trie") as space:
        return sorted((tuple(r) for r in trie.of_conversations(spark.createDataFrame(rows, SCHEMA), space).collect()), key=repr)


def drawn(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(r.choice((1, 1, 2, 3, 5, 8))):
            rows.append((r.choice((c, c, -c)), r.choice((k, k, k, None)), r.choice(("user", "user", None)), r.choice(("a", "a", "a b", "c d  e", None))))
    return rows


@pytest.mark.parametrize("partitions", (1, 4, 23))
def test_nodes_by_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for seed in range(2):
            rows = drawn(seed, 120)
            assert got(spark, rows) == expected(rows)
        # A third of all conversations is one and the same, another third begins alike; one is long.
        hot = [(c, k, "user", f"turn {k}") for c in range(300) for k in range(3)] + [(c, k, "user", f"turn {k if k < 4 else c * k}") for c in range(300, 500) for k in range(6)] + [(999, k, "x", "w " * (k % 3)) for k in range(400)]
        assert got(spark, hot) == expected(hot)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(3, None, None, None)], [(3, 1, "a", "b"), (3, 1, "a", "b"), (23, 1, "a", "b")], [(c, 0, "u", "same") for c in range(40)]):
        assert got(spark, rows) == expected(rows)


@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=5), st.integers(0, 9)), max_size=12), max_size=7))
def test_merge(runs):
    rows = sorted((s, c) for run in runs for s, c in run)
    out = list(trie.merged([trie.Run((s, c, []) for s, c in run) for run in runs]))
    assert [x[:2] for x in out] == rows
    assert [x[3] for x in out] == [trie.common(a, b) for a, b in zip([[], *[s for s, _ in rows]], [s for s, _ in rows])]


def test_shared_turns_are_not_compared_again():
    """Merging compares turns beyond the known prefixes only: at most one mismatch a step, and each shared turn once a row."""

    class Counted(bytes):
        n = 0

        def __eq__(self, other):
            Counted.n += 1
            return bytes.__eq__(self, other)

        __hash__ = bytes.__hash__

    # Merged with nothing known every step would compare 500 turns with each of 3 others; here a row's shared turns are compared when it enters at most.
    runs = [trie.Run(([b"%d" % k for k in range(500)] + [b"x%04d" % (4 * i + r)], i, []) for i in range(100)) for r in range(4)]
    for run in runs:
        run.rows = [([Counted(x) for x in s], c, w) for s, c, w in run.rows]
    Counted.n = 0
    assert len(list(trie.merged(runs))) == 400
    assert Counted.n < 4 * 500 + 400 * 8
