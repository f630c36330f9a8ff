import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import packing, tokens
from faultline.llm.tokens import default_path

SCHEMA = "doc_id long, text string, length string, task int"


def check(docs, rows, capacity=4096):
    """Every id of every row is packed once, whole and in order, and sequences have no holes."""
    model = Tokenizer.from_file(default_path())
    want = []
    for doc, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc, k, at, len(part), zlib.crc32(array("I", part).tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in filled.values())
    return filled


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, "a b c"), (3, "the end. " * 5000), (4, "it's Σ ends × 12"), (4, "it's Σ ends × 12"), (5, "a\x1cb<|endoftext|>")]
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in docs], SCHEMA)
    check(docs, packing.pack(df).collect())
    check(docs, packing.pack(df, capacity=16).collect(), 16)
    assert packing.pack(df.limit(0)).collect() == []


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(1, "one two three", "", 0)], SCHEMA)
    (r,) = packing.pack(df, with_ids=True).collect()
    assert list(array("I", bytes(r.ids))) == [*Tokenizer.from_file(default_path()).encode("one two three", add_special_tokens=False).ids, 1]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    filled = check([tuple(r) for r in docs.collect()], packing.pack(docs).collect())
    assert len(filled) <= -(-sum(filled.values()) // 4096) + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_best_fit_decreasing(seed):
    random.seed(seed)
    capacity = random.choice([7, 64, 4096])
    sizes = [min(capacity, 1 + int(random.expovariate(random.choice([1, 4, 30]) / capacity))) for _ in range(3000)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    rows = packing.plan(counts, capacity)
    held = {}
    for size, first, n, each, sequence, offset in rows.tolist():
        for j in range(n):
            held.setdefault(sequence + j // each, []).append((offset + j % each * size, size))
    assert sorted(s for x in held.values() for _, s in x) == sorted(sizes)
    for x in held.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= capacity
    gaps = []
    for s in sorted(sizes, reverse=True):
        if fit := [g for g in gaps if g >= s]:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    assert len(held) <= len(gaps) * 1.01 + 1


def test_ids_when_hashes_clash(monkeypatch):
    """Pieces are told apart though a poor hash gives eight values only."""
    plain = tokens.hashes
    monkeypatch.setattr(tokens, "hashes", lambda data, a, b: plain(data, a, b) & np.uint64(7))
    monkeypatch.setattr(tokens, "_OPEN", {})
    text = " ".join(random.Random(3).choices("alpha beta gamma delta, epsilon. zeta 12 eta; theta iota (kappa) lambda mu".split(), k=400))
    got = tokens.tokenizer(default_path()).ids(pa.array([text, "beta alpha", None]))
    model = Tokenizer.from_file(default_path())
    assert [list(array("I", x)) for x in got] == [model.encode(t, add_special_tokens=False).ids for t in (text, "beta alpha", "")]


def swept(counts, capacity, tasks):
    """The rounds as sweeps over rows: documents and gaps range-sorted and cut into ranges, with carries between the ranges.

    A sequence's rows, each a length, in the order in which they are placed.
    """
    left = sorted(s for s, n in counts.items() for _ in range(n))
    placed = [[s] for s in reversed(left) if 2 * s > capacity]
    left = [s for s in left if 2 * s <= capacity]
    while left:
        gaps = sorted((capacity - sum(x), k) for k, x in enumerate(placed) if sum(x) < capacity)
        rows = sorted([(s, 0, i) for i, s in enumerate(left)] + [(g, 1, k) for g, k in gaps])
        cut = -(-len(rows) // tasks)
        carry, taken = [], {}
        for at in range(0, len(rows), cut):  # each range is one task's; what waits there goes on to the next
            waiting = carry
            for size, kind, k in rows[at : at + cut]:
                if kind == 0:
                    waiting = [*waiting, k]
                elif waiting:  # the longest that waits has the highest rank
                    taken[k] = waiting[-1]
                    waiting = waiting[:-1]
            carry = waiting
        if taken:
            for k, i in taken.items():
                placed[k].append(left[i])
            gone = set(taken.values())
            left = [s for i, s in enumerate(left) if i not in gone]
        else:
            n = -(-sum(left) // capacity)
            placed += [[s] for s in reversed(left[-n:])]
            left = left[:-n]
    return placed


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_runs_are_the_sweeps_over_rows(tasks):
    """Where all lengths differ, moving runs of equal sizes is the sweep over rows, row for row; cuts into ranges change nothing."""
    r = random.Random(11)
    capacity = 4096
    sizes = r.sample(range(1, capacity + 1), 700)
    got = {}
    for size, first, n, each, sequence, offset in packing.plan(dict.fromkeys(sizes, 1), capacity).tolist():
        assert (first, n, each) == (0, 1, 1)
        got.setdefault(sequence, []).append((offset, size))
    ours = sorted([s for _, s in sorted(x)] for x in got.values())
    assert ours == sorted(swept(dict.fromkeys(sizes, 1), capacity, tasks))


def test_intervals_stay_few():
    """Rounds and intervals don't grow with the number of documents: a hundred times as many give about as many."""
    sizes = random.Random(5).choices(range(1, 4097), weights=[4097 - s for s in range(1, 4097)], k=20_000)
    counts = {s: sizes.count(s) for s in set(sizes)}
    few, many = (len(packing.plan({s: n * k for s, n in counts.items()}, 4096)) for k in (1, 100))
    assert few <= 8 * 4096 and many <= 2 * few
