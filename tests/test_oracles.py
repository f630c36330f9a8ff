import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__
from faultline.functions import python
from faultline.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, sf_dir, name):
    compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE[name])


def applied(old, patch):
    """old with a unified diff applied."""
    a, out, at = re.findall(r"[^\n]*\n|[^\n]+", old), [], 0
    lines = patch.split("\n")[2:-1]
    for i, x in enumerate(lines):
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", x):
            start = int(m[1]) - (m[2] != "0")
            out += a[at:start]
            at = start
        elif x[0] in " -":
            bare = lines[i + 1][0] == "\\" if i + 1 < len(lines) else False
            assert a[at].rstrip("\n").expandtabs() == x[1:] and a[at].endswith("\n") != bare
            out += [a[at]] if x[0] == " " else []
            at += 1
        elif x[0] == "+":
            out.append(x[1:] + ("" if i + 1 < len(lines) and lines[i + 1][0] == "\\" else "\n"))
    return "".join(out + a[at:])


def test_text_diff(spark, sf_dir):
    """Each diff, applied to the document, gives its text without repeated lines."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in catalogue.text_diff(spark, sf_dir).collect():
        want = "\n".join(dict.fromkeys(docs[r.doc_id].split("\n")))
        assert (r.diff == python.IDENTICAL) == (want == docs[r.doc_id])
        if r.diff != python.IDENTICAL:
            assert applied(docs[r.doc_id], r.diff).expandtabs() == want.expandtabs()


@given(st.lists(st.sampled_from("abcdxyz"), max_size=30), st.lists(st.sampled_from("abcdxyz"), max_size=30), st.booleans())
def test_diffs_apply(a, b, ended):
    old, new = ("".join(x + "\n" for x in y) for y in (a, b))
    new = new if ended else new[:-1]
    got = python.diff(old, new)
    assert got == python.IDENTICAL if old == new else applied(old, got) == new


def kept(a, b):
    """The length of the longest common subsequence, by its plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@given(st.lists(st.sampled_from("abcdxyz"), max_size=40), st.lists(st.sampled_from("abcdxyz"), max_size=40), st.sampled_from([1, 30, 1 << 24]))
def test_diffs_are_minimal(a, b, bits):
    got = python.matching(a, b, bits)
    assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(got) == kept(a, b)


def test_diff_of_lines_that_all_repeat():
    """Three edits in 1,500 lines of eight kinds change three lines, and in 60,000 lines as well."""
    for n, seed in ((1500, 1), (60_000, 2)):
        r = random.Random(seed)
        old = [f"kind {r.randrange(8)}\n" for _ in range(n)]
        new = [*old[:100], "added\n", *old[100 : n // 2], *old[n // 2 + 1 : n - 50], "other\n", *old[n - 50 :]]
        marks = [x[0] for x in python.diff("".join(old), "".join(new)).split("\n")[2:] if x]
        assert (marks.count("-"), marks.count("+")) == (1, 2)


def test_diffs_of_tabs_and_long_texts():
    """Tabs differ from spaces, and a text of 50,000 lines takes seconds."""
    assert python.diff("a\tb\n", "a       b\n") != python.IDENTICAL
    old = "".join(f"line {i % 500}\n" for i in range(50_000))
    new = "".join(f"line {i % 500}\n" for i in range(50_000) if i % 7).replace("line 13\n", "other\n")
    began = time.time()
    assert applied(old, python.diff(old, new)) == new
    assert time.time() - began < 30


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
