import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import fim


@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 300))
def test_lists(values, above):
    values = np.sort(np.array(values, np.int64))
    data = fim.encoded(values, (int(values[-1]) if len(values) else 0) + above)
    assert fim.length(data) == len(values)
    assert [fim.select(data, i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        fim.select(data, len(values))


def test_lists_are_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 13, 100_000))
    assert len(fim.encoded(values, int(values[-1]))) * 8 < 5 * len(values)


def expected(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, sha = len(tokens), lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


TEXTS = [None, "", " ", "one", " \n one  two\t", "no break   wide ü 𝔘 end ", "a <P> sentinel", "<", "<S", "S> <P", "x" * 100_000, "wörd " * 30_000, "same text of some copies", "\x00 zero \x1f odd"]


def test_cuts_by_brute_force(spark):
    rows = [(i + 100 * k, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id here at all"), (5, "again"), (5, "again")] + [(10_000 + i, "a hot text") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in fim.digests(fim.transform(docs)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fim.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"text {'word ' * (i % 5)}") for i in range(200)]
    got = [tuple(r) for r in fim.digests(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(got) == sorted(expected(*r) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, n string, row string")
    got = fim.transform(docs)
    assert set(got.columns) == {"doc_id", "text", "row", *fim.MADE} and got.collect()[0].row == "y"
    assert fim.transform(docs.limit(0)).collect() == []
    number = fim.transform(spark.createDataFrame([(1, 22)], "doc_id long, text long")).collect()
    assert number[0].n == 1
