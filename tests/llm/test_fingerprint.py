import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import fingerprint as fp


def plain_walks(text):
    """The embedding step by step: one character at a time, as the method is told."""
    c = [1 + ((ord(x) * 2654435761 % (1 << 32)) >> 16) % 15 for x in text]
    goes = np.random.default_rng(fp.SEED).integers(0, 2, (fp.PERIOD, fp.WALKS, 4, 16))
    blocks, level = fp.shape(len(text))
    kept, out = set(fp.samples(level, blocks).tolist()), []
    for w in range(fp.WALKS):
        i, seen = 0, []
        for step in range(4 * blocks):
            here = c[i] if i < len(c) else 0
            if step % 4 == 0 and step // 4 in kept:
                seen.append(here)
            i += bool(here and goes[step // 4 % fp.PERIOD, w, step % 4, here])
        out.append(seen)
    return level, out


def plain_likeness(a, b):
    level = max(a[0], b[0])
    best, empty = 0.0, True
    for w in range(fp.WALKS):
        sides = []
        for lv, walks in (a, b):
            own = fp.samples(lv, 1 << 18)[: len(walks[w])].tolist()
            top = set(fp.samples(level, 1 << 18).tolist())
            sides.append({k: v for k, v in zip(own, walks[w]) if k in top and v})
        x, y = sides
        there = len(set(x) | set(y))
        empty &= not there
        best = max(best, sum(x[k] == y.get(k) for k in x) / there if there else 0.0)
    return 1.0 if empty else best


def prints(texts):
    return [(fp.shape(len(t))[1], w) for t, w in zip(texts, fp.embedded(texts), strict=True)]


@given(st.lists(st.text(max_size=300), min_size=1, max_size=5))
def test_walks_by_steps(texts):
    for t, w in zip(texts, fp.embedded(texts), strict=True):
        assert w.tolist() == plain_walks(t)[1]
        level, again = fp.parsed(fp.shown(fp.shape(len(t))[1], w))
        assert level == fp.shape(len(t))[1] and np.array_equal(again, w[:, : again.shape[1]]) and not w[:, again.shape[1] :].any()


def test_likeness_across_levels():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    for n in (1, 10, 30, 100, 400):
        a = " ".join(word() for _ in range(n))
        others = [a, a + " more", a[: int(len(a) * 0.95)], fp.edited(a, " ".join(word() for _ in range(n))), a * 2, word(), ""]
        x, found = prints([a])[0], prints(others)
        assert [fp.likeness(x, y) for y in found] == pytest.approx([plain_likeness(x, (lv, w.tolist())) for lv, w in found])
        assert fp.likeness(x, found[0]) == 1.0 and fp.likeness(x, found[-1]) == 0.0
    assert fp.likeness(*prints(["", ""])) == 1.0


def test_likeness_tells_edits_from_other_texts():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("eeettaaoinshrdlucm") for _ in range(r.randrange(1, 10))) for _ in range(r.randrange(150, 900))) for _ in range(60)]
    few = [t[:400] + "!" + t[400:900] + t[903:] for t in texts]
    half = [fp.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    own, few, half = prints(texts), prints(few), prints(half)
    assert np.mean([fp.likeness(a, b) > 0.9 for a, b in zip(own, few)]) > 0.9
    assert all(0.4 < fp.likeness(a, b) < 0.8 for a, b in zip(own, half))
    assert all(fp.likeness(a, b) < 0.35 for a, b in zip(own, own[1:]))


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = prints([t, e, following])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.shown(*a), fp.shown(*b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=repr)


TEXTS = [None, "", "a", "ab", "ü𝔘 ß", "word " * 40, "x" * 5000, "wörd " * 30_000, "some other text of a dozen words that is no copy of any"]
COLUMNS = [c.split()[0] for c in fp.PRINTS.split(", ")]


@pytest.mark.parametrize("partitions", (1, 4, 30))
def test_rows_by_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS)] + [(1000 + i, "hot text") for i in range(200)] + [(None, "no id")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit("x"), "range": F.lit(1)})
        got = fp.of_documents(docs.repartition(3)).select(*COLUMNS).collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ties_and_edges(spark):
    rows = [(5, f"tie {i} " * 20) for i in range(20)] + [(5, "tie"), (5, "tie")]
    got = fp.of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.n_chars for r in got} == {len(t) for _, t in rows}
    one = fp.of_documents(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].n_near == 0 and one[0].near_id == 1
    assert fp.of_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_against_all_pairs(spark):
    """Links of all pairs of fingerprints; a chain, copies, and a hot family."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("eeettaaoinshrdlucm") for _ in range(r.randrange(1, 10)))

    def near(t, k=1):
        w = t.split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = word()
        return " ".join(w)

    texts = [" ".join(word() for _ in range(r.randrange(3, 700))) for _ in range(120)]
    texts += [near(t) for t in texts[:80]] + texts[:20]
    family = " ".join(word() for _ in range(300))
    texts += [near(family, 2) for _ in range(150)] + [family] * 60
    got = {x.doc_id: x for x in fp.of_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = prints(texts)
    n = len(texts)
    links = [[j for j in range(n) if j != i and (texts[i] == texts[j] or fp.likeness(found[i], found[j]) >= fp.NEAR)] for i in range(n)]
    assert all(got[i].n_near <= len(links[i]) for i in range(n))
    assert sum(got[i].n_near for i in range(n)) >= 0.97 * sum(map(len, links))
    for i in range(n):
        if texts.count(texts[i]) > 1:
            assert got[i].near_id == got[texts.index(texts[i])].near_id <= texts.index(texts[i])


def test_bands_of_a_text_do_not_depend_on_the_table(spark):
    """What a text's bands are is up to its fingerprint alone, so more texts beside it part no links."""
    one = pa.RecordBatch.from_pylist([{"id": 1, "fingerprint": fp.shown(0, fp.embedded(["a text of a few words " * 3])[0]), "n_chars": 66}])
    found = [b for x in fp._bands(iter([one])) for b in x.column("band").to_pylist()]
    many = pa.RecordBatch.from_pylist([{"id": i, "fingerprint": fp.shown(0, fp.embedded([f"other {i} words " * 4])[0]), "n_chars": 60} for i in range(2, 40)] + one.to_pylist())
    again = [b for x in fp._bands(iter([many])) for b, i in zip(*(c.to_pylist() for c in x.columns)) if i == 1]
    assert found == again and len(found) >= fp.BANDS == 12
