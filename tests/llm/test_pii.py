import hashlib
import itertools
import re
import time

import numpy as np
import pyarrow as pa

from faultline.llm import pii


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


ODD = [None, "", "a@b.c@d.e a@b.c_d@e.f @x.y x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 00000000000000001.2.3.4", "é+1 (499) 555-6503, ü 4227025300029028.", "4227 0253 0002 9028-4227025300029028", "+1 +12345678 9 ((", "１２３４ x@é.com ٣٣٣", "call (499) 555-6503 now or 499-555-6503."]


def test_base_spans_against_plain_patterns(spark, sf_dir):
    docs = [(i, t) for i, t in enumerate(ODD)] + [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = pii.find(spark.createDataFrame([(d, t, "") for d, t in docs], "doc_id long, text string, spans string")).collect()
    key = lambda r: repr(r[:6])
    want = []
    for d, t in docs:
        spans = brute(t)
        want.append((d, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(pii.joined(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(set(r.spans.split(",")) - {""}) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert sorted(map(key, got))


def test_field_on_unseen_sentences():
    field = pii.default_field()
    table = pii.labelled_table(400, seed=99)
    w = pii.Words(*pii.words.flat(pa.array([" ".join(x for x, _ in row) for row in table])))
    got = field.decode(w, *pii.windows(w))
    want = [(("none",) + pii.KINDS).index(label) for row in table for _, label in row]
    hit = [i for i, y in enumerate(want) if y]
    assert sum(got[i] == want[i] for i in hit) >= 0.95 * len(hit)
    assert sum(g > 0 and not y for g, y in zip(got, want)) <= 0.01 * len(want)


def test_field_adds_what_patterns_miss():
    (base, more), = pii.spans_of(pa.array(["ouh erth (499) 555-6503 ineath the"]), pii.default_field())
    assert base == [] and more == [("phone", 9, 23)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a.b@c.de, or +1 (499) 555-6503 now", 9), (2, None, 0), (None, "", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("é mail [EMAIL], or [PHONE] now", 30), 2: (None, None), None: ("", 0)}
    assert pii.redact(df.limit(0)).collect() == pii.find(df.limit(0)).collect() == []


def test_long_runs_take_linear_time():
    began = time.time()
    pii.spans_of(pa.array(["a" * 3_000_000 + "@", "1" * 3_000_000, "+1" + "(" * 2_000_000, "1 " * 100_000]), pii.default_field())
    assert time.time() - began < 60


def added(text):
    (base, more), = pii.spans_of(pa.array([text]), pii.default_field())
    assert not any(a < y and x < b for _, a, b in more for _, x, y in base)
    return [(k, text[a:b]) for k, a, b in more]


def test_neighbouring_items_are_each_found():
    phones = [f"555-123-45{i}" for i in range(60, 80)]
    assert added("call " + "\n".join(phones)) == [("phone", p) for p in phones]
    assert added("we (499) 555-6503 (499) 555-6504 now") == [("phone", "(499) 555-6503"), ("phone", "(499) 555-6504")]
    assert added("4227025300029027 4227025300029026") == [("card", "4227025300029027"), ("card", "4227025300029026")]
    assert added("+1 499-555-6503\n499-555-6504") == [("phone", "499-555-6504")]
    assert added("+1 (499)\n555-6503 is") == [("phone", "+1 (499)\n555-6503")]
    began = time.time()
    pii.items("phone", "1 " * 200_000, [(i, i + 1) for i in range(0, 400_000, 2)])
    pii.items("phone", "1" + " (" * 200_000 + " 1", [(i, i + 1) for i in range(0, 400_003, 2)])
    assert time.time() - began < 20


def test_lists_are_masked(spark):
    df = spark.createDataFrame([(1, "555-123-4567\n555-123-4568\n+1 499-555-6503\n499-555-6504")], "doc_id long, text string")
    assert pii.redact(df).first().text == "[PHONE]\n[PHONE]\n[PHONE]\n[PHONE]"


def test_viterbi_against_enumeration():
    """On short chains the decoded labels are the best of all labellings."""
    rng = np.random.default_rng(3)
    table = [["call", "+1", "499", "at"], ["mail", "a@b.c"], ["10", ".", "0"], ["x"]]
    w = pii.Words(*pii.words.flat(pa.array([" ".join(r) for r in table])))
    for _ in range(20):
        field = pii.Field(np.unique(w.shape))
        field.emit, field.step, field.edge = rng.normal(size=field.emit.shape), rng.normal(size=field.step.shape), rng.normal(size=field.edge.shape)
        got, s = field.decode(w, *pii.windows(w)), field.emit[field.index(w)].sum(1)
        at = 0
        for row in table:
            best = max(itertools.product(range(5), repeat=len(row)), key=lambda y: sum(s[at + i, k] for i, k in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])) + field.edge[0, y[0]] + field.edge[1, y[-1]])
            assert tuple(got[at : at + len(row)]) == best
            at += len(row)


def test_gradient_of_the_likelihood():
    """One step of training moves against the numeric gradient of the log-likelihood over all labellings."""
    rng = np.random.default_rng(4)
    w = pii.Words(*pii.words.flat(pa.array(["a 1 b@c", "2 x"])))
    y, first, last = np.array([0, 4, 1, 4, 0]), np.array([0, 3]), np.array([3, 5])

    def loss(field):
        s, total = field.emit[field.index(w)].sum(1), 0.0
        for f, e in zip(first, last):
            value = lambda z: sum(s[f + i, k] for i, k in enumerate(z)) + sum(field.step[a, b] for a, b in zip(z, z[1:])) + field.edge[0, z[0]] + field.edge[1, z[-1]]  # noqa: B023, E731
            every = [value(z) for z in itertools.product(range(5), repeat=e - f)]
            total += np.log(np.exp(every).sum()) - value(tuple(y[f:e]))
        return total / 2 + 0.0005 * sum((x * x).sum() for x in (field.emit, field.step, field.edge))

    field = pii.Field(np.unique(w.shape))
    field.step, field.edge = rng.normal(size=field.step.shape), rng.normal(size=field.edge.shape)
    field.emit = rng.normal(size=field.emit.shape)
    for name, at in (("step", (0, 4)), ("step", (4, 1)), ("edge", (0, 0)), ("edge", (1, 1)), ("emit", (1, 0)), ("emit", (2, 4))):
        param = getattr(field, name)
        param[at] += 1e-5
        up = loss(field)
        param[at] -= 2e-5
        down = loss(field)
        param[at] += 1e-5
        before, slope = [x.copy() for x in (field.emit, field.step, field.edge)], (up - down) / 2e-5
        if abs(slope) > 1e-6:
            field.train(field.index(w), y, first, last, rounds=1, rate=1e-3)
            assert np.sign(getattr(field, name)[at] - dict(zip(("emit", "step", "edge"), before))[name][at]) == -np.sign(slope)
            field.emit, field.step, field.edge = before


def test_windows_give_the_labels_of_whole_texts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    field = pii.default_field()
    w = pii.Words(*pii.words.flat(pa.array(texts, pa.string())))
    first = np.flatnonzero(np.append(True, w.doc[1:] != w.doc[:-1]))
    assert (field.decode(w, first, np.append(first[1:], len(w.starts))) == field.decode(w, *pii.windows(w))).all()


#: Written by hand, not by the generator.
BY_HAND = [
    ("write to jane at example dot com today", [("email", "jane at example dot com")]),
    ("you reach bob [at] mail [dot] example [dot] org any time", [("email", "bob [at] mail [dot] example [dot] org")]),
    ("my number is five five five one two three four five six seven if needed", [("phone", "five five five one two three four five six seven")]),
    ("ring 499 555 6503 before noon", [("phone", "499 555 6503")]),
    ("office (020) 7946-0958 or home", [("phone", "(020) 7946-0958")]),
    ("the host 10[.]20[.]30[.]40 was blocked", [("ip", "10[.]20[.]30[.]40")]),
    ("he met her at the door and dot their names", []),
    ("there were two of them and three of us at home", []),
    ("version 1.2.3 came out on 2020-11-26 with 40% more", []),
    ("it costs $12.50 for 3 and 1,000 in all", []),
]


def test_sentences_written_by_hand():
    wrong = [(t, added(t)) for t, want in BY_HAND if added(t) != want]
    assert len(wrong) <= 1, wrong
    assert not [x for x in wrong if dict(BY_HAND)[x[0]] == []]  # clean ones are left alone


def test_clean_documents_are_left_alone(spark, sf_dir):
    """Of texts without any digit or @ hardly any gets a span."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text not rlike '[0-9@+]'").select("text").collect()]
    assert sum(bool(more) for _, more in pii.spans_of(pa.array(texts, pa.string()), pii.default_field())) == 0
