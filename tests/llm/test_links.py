import random

import numpy as np
import pytest

from faultline.llm import lattice, ngram_join
from faultline.llm.links import components
from faultline.llm.shared import Workspace


def closure(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute_texts(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12]
    comp = closure(ids, pairs)
    n = dict.fromkeys(ids, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in ids}


def test_components(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(random.randrange(100), random.randrange(100)) for _ in range(70)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t"), "t").collect()}
    want = closure({x for p in pairs for x in p}, pairs)
    assert {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)} == got


def test_join_against_brute_force(spark, sf_dir):
    random.seed(5)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    word = lambda: "".join(random.choices("abcdefg", k=3))
    seed = [word() for _ in range(150)]
    for k in range(300):  # a large group of near copies
        w = list(seed)
        for _ in range(random.randrange(6)):
            w[random.randrange(150)] = word()
        docs.append((10_000 + k, " ".join(w)))
    docs += [(20_000, None), (20_001, ""), (20_002, "a b"), (20_003, " a\tb "), (20_004, "b a"), (20_005, "x y z q r"), (20_006, "x y z q r")]
    want = brute_texts(docs)
    got = ngram_join.join(spark.createDataFrame([(d, t, "t", 1) for d, t in docs], "doc_id long, text string, id string, n int")).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == want
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)


def test_join_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q q q q q q q"), (9, "z " * 100_000)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df).collect()), key=repr)
    assert got == sorted([(None, 4, 2, 4, False), (4, 4, 2, 4, True), (4, 4, 2, 4, True), (None, None, 0, None, True), (9, 9, 0, 9, True)], key=repr)
    assert ngram_join.join(df.limit(0)).collect() == []


def test_large_buckets_split_and_end_in_blocks(spark, monkeypatch):
    """Buckets over a small bound take the leader's way, further levels and the blocks."""
    random.seed(8)
    seed = [str(i) for i in range(120)]
    docs = []
    for k in range(80):
        w = list(seed)
        for _ in range(random.randrange(5)):
            w[random.randrange(120)] = f"x{random.random()}"
        docs.append((k, " ".join(w)))
    plain = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda c, s, r, least: plain(c, s, r, least, small=3, levels=2, chunk=16))
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block=16).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == brute_texts(docs)


def test_e8_decoding():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(400, 8)) * 2
    near = lattice.decode(y)
    assert ((near.sum(1) % 2) == 0).all() and (((near % 1) == 0).all(1) | ((near % 1) == 0.5).all(1)).all()
    d = ((y - near) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()
    assert len(lattice.neighbours()) == 240
    for v in lattice.neighbours():
        assert (d <= ((y - near - v) ** 2).sum(1) + 1e-9).all()


def brute_vectors(rows):
    ok = {i: (label, np.array(v, float)) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                pairs.append((a, b))
    comp = closure([r[0] for r in rows], pairs)
    n = {r[0]: 0 for r in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize(("block", "small"), [(512, 64), (8, 4), (40, 1)])
def test_vectors_against_brute_force(spark, sf_dir, block, small):
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    seed = rng.normal(size=64)
    for k in range(120):
        v = (seed + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14])).astype(np.float32)
        rows.append((100_000 + k, [float(x) for x in v], k % 2))
    rows += [(200_000, None, 1), (200_001, [0.0] * 64, 1), (200_002, rows[-1][1], None), (200_003, [1.0, float("nan")], 1), (200_004, [1.0, None], 1), (200_005, [1.0, 2.0], 1), (200_006, [1.0, 2.0], 1), (200_007, [], 1), (200_008, [float("inf")] * 64, 2)]
    rows += [(200_010 + k, rows[-20][1], rows[-20][2]) for k in range(3)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block, small=small).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_vectors_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, id int")).collect() == []


def by_rows(rows, pairs):
    """n_links and component's smallest id of each row, rows told apart by their places."""
    comp = closure(range(len(rows)), pairs)
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    named = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            named[comp[i]] = min(r[0], named.get(comp[i], r[0]))
    return n, [named.get(comp[i]) for i in range(len(rows))]


def test_texts_with_null_and_repeated_ids(spark):
    """Links of null ids count, and texts that share an id keep links of their own."""
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda w, k: " ".join([*w[:k], "x", *w[k + 1 :]])
    rows = [(1, " ".join(base)), (None, near(base, 0)), (None, near(base, 59)), (7, " ".join(other)), (7, near(base, 58)), (3, near(other, 59)), (None, "q r s t u v"), (None, "q r s t u v"), (5, "alone in the world it stands")]
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    n, top = by_rows(rows, pairs)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_links, r.component_id) for r in got], key=repr) == sorted(zip([r[0] for r in rows], n, top), key=repr)
    stay = ngram_join.deduplicated(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, file int"))
    assert stay.columns == ["doc_id", "text", "file"]
    # One of each component: the smallest id, null last; texts that share id 7 are apart.
    assert sorted(r.file for r in stay.collect()) == sorted([0, 5, 8] + [min(r.file for r in stay.where("text = 'q r s t u v'").collect())])


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 16))
    rows = [(1, a), (None, a + rng.normal(size=16) * 0.01), (None, a * 2), (4, b), (4, a + rng.normal(size=16) * 0.01), (None, b * 1.0), (None, -b), (9, -a)]
    unit = [v / np.linalg.norm(v) for _, v in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] @ unit[j] >= 0.98]
    n, top = by_rows(rows, pairs)
    got = lattice.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v], "k") for i, v in rows], "vec_id long, embedding array<double>, label string")).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == sorted(zip([r[0] for r in rows], n, top), key=repr)


def pairs_at(n, dimension, cosine, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, n, dimension))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize(("n", "dimension"), [(500, 64), (60_000, 64), (60_000, 384), (1 << 30, 64)])
def test_recall_of_single_pairs(n, dimension):
    """At any size 99 % of pairs meet and pass the sketches, without any help by other vectors."""
    how = lattice.plan(dimension, n, 0.98, 0.999)
    for cosine, least in ((0.98, 0.99), (0.985, 0.995), (0.99, 0.999)):
        x, y = pairs_at(1500, dimension, cosine, seed=[n, dimension])
        met = np.zeros(len(x), bool)
        for t in range(how.tables):
            a, b = (lattice.cells(u, t, how.parts, how.scale, how.probes) for u in (x, y))
            met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
        near = ((lattice.sketch(x).astype(int) - lattice.sketch(y)) ** 2).sum(1) <= lattice.reach(dimension, 0.98) + 0.5
        assert (met & near).mean() >= least


def test_unrelated_vectors_hardly_meet_at_any_size():
    """Cells get finer with the number of vectors: 20 times as many meet about as many others each."""
    rng = np.random.default_rng(6)
    each = {}
    for n in (1500, 30_000):
        how = lattice.plan(64, n, 0.98, 0.999)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        rows = 0
        for t in range(how.tables):
            h = lattice.cells(x, t, how.parts, how.scale, how.probes).ravel()
            _, count = np.unique(h, return_counts=True)
            rows += int((count * (count - 1)).sum())
        each[n] = rows / n
        assert how.tables * (1 + how.probes) <= 21
    assert each[30_000] <= 16 and each[30_000] <= 3 * max(each[1500], 1)


def test_large_family_of_texts(spark):
    """One family of variants in several blocks, beside a very long text with a copy."""
    random.seed(9)
    seed = [f"w{i}" for i in range(150)]
    docs = []
    for k in range(400):
        w = list(seed)
        for _ in range(random.randrange(7)):
            w[random.randrange(150)] = f"x{random.random()}"
        docs.append((k, " ".join(w)))
    long = " ".join(f"z{i}" for i in range(100_000))
    docs += [(5000, long), (5001, long + " and an end of it"), (5002, long[: len(long) // 2])]
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block=64).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == brute_texts(docs)
